"""Corpus operators on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from trestle.llm import bpe, fingerprints, line_dedup, minhash, mixing, quality_gbt, quality_rules, samples, suffix_dedup, token_counts, toxicity  # noqa: E402
from trestle.llm.queries import END_OF_DOCUMENT, vocabulary  # noqa: E402
from trestle.llm.vocab import encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, key string"
PASSAGE = " ".join(f"passage{i}" for i in range(40))
LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))


def _texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma kappa theta".split()) + str(rng.randint(0, 300)) for _ in range(n))
    base = prose(120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        None, "", " \n\t ", "one two", base, base, near, f"{prose(60)}\n{PASSAGE}\n{prose(30)}", f"{prose(50)}\n{PASSAGE}", LONG, "###$$$ %%% " * 40, "a b c d e " * 30,
        "déjà vu 😀 中文字符 don't WE'LL ٣٤", "tie", "tie", "no spaces" + "x" * 900,
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(i + 1, t, ["en", "de", None][i % 3], ["src0", "src12", None, "src0"][i % 4], len(t or ""), 7, True, "k") for i, t in enumerate(_texts())]
    return [*out, out[4]]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rules_measure_and_ablate(spark, docs, none, rows):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].kept and not got[11].kept and got[12].n_repeat_words == 150 and got[12].base_failed
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 2
    table = {(r.policy, r.rule): r for r in quality_rules.ablation(quality_rules.judged(docs)).collect()}
    assert table[("base", "few_words")].n_failed == sum(len((t or "").split()) < 10 for _, t, *_ in rows)
    assert quality_rules.judged(none).count() == 0


def test_bpe_equals_library_and_round_trips(docs, none, rows):
    path, own = vocabulary(), encoder(vocabulary(), public_tokenizers.PATTERN)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    whole = bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((r.doc_id, len(r.ids), sha(bytes(r.bytes))) for r in whole) == sorted((i, n, d) for i, n, _, d in want)
    assert bpe.encoded(none, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts_across_blocks(docs, rows, block):
    own = encoder(vocabulary(), public_tokenizers.PATTERN)
    got = token_counts.token_counts(docs, vocabulary(), public_tokenizers.PATTERN, END_OF_DOCUMENT, block)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((i, len(own.encode_ordinary(t or ""))) for i, t, *_ in rows)


def _shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize("tile", [256, 2])
def test_minhash_equals_brute_force(docs, rows, none, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    sets = {i: _shingles(t, 4) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 4).collect()}
    assert got == {(i, len(sets[i]), label[i], label[i] == i) for i in sets}
    assert minhash.kept_documents(docs, 4).columns == docs.columns
    if tile == 256:
        assert minhash.near_duplicates(none, 4).count() == 0


def test_line_dedup_keeps_first_of_near_equal_lines(spark, docs, none):
    out = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert list(out[6].removed_lines) == [0] and list(out[5].removed_lines) == [] and list(out[7].removed_lines) == [0]
    assert list(out[8].removed_lines) == [] and list(out[9].removed_lines) == [1] and list(out[15].removed_lines) == [0]
    clean = line_dedup.deduplicated(docs)
    assert clean.columns == docs.columns and clean.filter("doc_id = 9").first().text == _texts()[8].split("\n")[0]
    assert clean.filter("doc_id = 1").first().text is None and clean.count() == docs.count()
    assert line_dedup.line_report(none).count() == 0


def _line_brute(texts):
    """Numbers of the lines to remove by document: components of all pairs of lines that reach 0.8, without signatures."""
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            first.setdefault(line, []).append((i, k))
    names = list(first)
    sets = [{x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in names]
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for a, x in enumerate(sets):
        shared = Counter(b for g in x for b in lists.get(g, ()))
        for g in x:
            lists.setdefault(g, []).append(a)
        for b, both in shared.items():
            if 9 * both >= 4 * (len(x) + len(sets[b])):
                parent[root(a)] = root(b)
    places = {}
    for a, x in enumerate(names):
        places.setdefault(root(a), []).extend(first[x])
    gone = {p for group in places.values() for p in group if p != min(group)}
    return {i: [k for k in range(t.count("\n") + 1) if (i, k) in gone] for i, t in enumerate(texts)}


def _family(rng, size):
    """A frequent line, and pairs of lines at 0.88 to each other and about 0.7 to it."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n - 2)).join("xy")
    hub, out = word(200), []
    for _ in range(size):
        at = rng.randint(1, 80)
        one = hub[:at] + word(28) + hub[at + 28 :]
        out += [one, one[:150] + word(5) + one[155:]]
    return hub, out


def _removed(spark, texts):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: list(r.removed_lines) for r in line_dedup.line_report(made).collect()}


@pytest.mark.parametrize(("tile", "partners"), [(256, 16), (8, 1)])
def test_line_dedup_links_lines_that_the_hub_does_not_take(spark, monkeypatch, tile, partners):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    monkeypatch.setattr(line_dedup, "MOST_PARTNERS", partners)
    rng = random.Random(11)
    hub, out = _family(rng, 60)
    rng.shuffle(out)
    texts = ["\n".join([hub, *out[k : k + 6]]) for k in range(0, len(out), 6)]
    want = _line_brute(texts)
    assert _removed(spark, texts) == want and sum(map(len, want.values())) >= 60


@pytest.mark.parametrize("tile", [256, 2])
def test_line_dedup_tiles_link_all_pairs_of_a_bucket(spark, monkeypatch, tile):
    """Whatever the chunks, each line with a near partner of a smaller hash hands one on; others hand on nothing."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(13)
    hub, out = _family(rng, 12)
    named = spark.createDataFrame([(k, x) for k, x in enumerate([hub, *out])], "h1 long, norm string")
    held = line_dedup.sketches(named, named)
    tiles = line_dedup.dealt(named.selectExpr("7L as key", "h1"), held).selectExpr("*", "h1 as label")
    got = {(r.u, r.v) for r in line_dedup.tile_links(tiles, held).collect()}
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for x in [hub, *out]]
    near = {(a, b) for a in range(25) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert got == near
    monkeypatch.setattr(line_dedup, "MOST_PARTNERS", 1)
    first = [(r.u, r.v, r.more) for r in line_dedup.tile_links(tiles, held).collect()]
    assert {(a, b) for a, b, _ in first} <= near and {a for a, *_ in first} == {a for a, _ in near} and all(m for *_, m in first)


def test_line_dedup_recall_on_the_corpus(spark):
    """All links of a corpus by brute force, and unbroken lines that differ in their first letter."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rng = random.Random(14)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(121)) for _ in range(40)]
    # ASCII letters only, so that Python and Java lower them alike
    texts = [(r.text or "").encode("ascii", "ignore").decode().lower() for r in spark.read.parquet(path).select("text").collect()]
    texts = [*["\n".join(x.strip(" \t\r\v\f") or "|" for x in t.split("\n")) for t in texts], *keys, *["z" + k[1:] for k in keys]]
    want, got = _line_brute(texts), _removed(spark, texts)
    lost = sum(len(set(want[i]) - set(got[i])) for i in want)
    assert sum(map(len, want.values())) > 100 and lost <= 0.01 * sum(map(len, want.values()))
    assert not sum(len(set(got[i]) - set(want[i])) for i in want) > lost and all(got[len(texts) - 1 - k] == [0] for k in range(40))


@pytest.mark.parametrize("line", ["x", "ab" * 4, "z" * 9, "wort " * 30_000])
def test_line_dedup_of_short_repeated_and_long_lines(spark, line):
    assert _removed(spark, [line, f"\n{line} ", f"{line}\n{line}"]) == {0: [], 1: [1], 2: [0, 1]}


def test_line_dedup_finds_unbroken_lines(spark):
    rng = random.Random(12)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(200)) for _ in range(20)]
    texts = [*keys, *[k[:3] + "z" + k[4:] for k in keys]]
    assert _removed(spark, texts) == _line_brute(texts) == {i: [0] * (i >= 20) for i in range(40)}


def test_suffix_array_and_repeats():
    rng = random.Random(2)
    for _ in range(800):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 25))]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert [a.tolist() for a in suffix_dedup.repeats([b"abcabx", b"zabc"], 3)] == [[0], [1]]


@pytest.mark.parametrize("most", [100, 2])
def test_suffix_dedup_equals_brute_force(docs, rows, none, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + 200] for _, b in raws for k in range(len(b) - 199))
    want = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        n = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(tuple(r) for r in suffix_dedup.report(docs).collect()) == sorted(want)
    if most == 100:
        assert suffix_dedup.report(none).count() == 0


def _gone(raws):
    """Brute force: doc, bytes, bytes removed of every string of 200 bytes that starts twice."""
    seen, want = Counter(b[k : k + 200] for _, b in raws for k in range(len(b) - 199)), []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, len(b), int(gone.sum())))
    return sorted(want)


def test_suffix_dedup_keeps_single_windows_of_frequent_halves(spark, monkeypatch):
    """Every half is in more texts than a group holds, every combination of halves in one text only."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 2)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pool = word(60_000)
    at = np.arange(len(pool) - 31)
    gram = suffix_dedup._hashes(suffix_dedup._sums(np.frombuffer(pool.encode(), np.uint8)), at, at + 32)
    least = pool[int(gram.argmin()) :][:32]
    left, right = [word(100) for _ in range(5)], [word(100) for _ in range(5)]
    texts = [a + least + b for a in left for b in right]
    texts.append(word(40) + texts[3] + word(40))
    raws = [(i, t.encode()) for i, t in enumerate(texts)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.report(made).collect()) == _gone(raws)


def test_fingerprints_follow_the_next_document(docs, rows, none):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(docs).collect())
    want = Counter()
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 3
        want[(i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())] += 1
    assert got == want
    assert fingerprints.fingerprints(none).count() == 0
    p, q = fingerprints.PrefixHash.of("abcdefgh"), fingerprints.PrefixHash.of("zcdefx")
    assert p.lce(2, q, 1) == 4 and p.same(2, q, 1, 4) and not p.same(2, q, 1, 5)
    assert np.array_equal(p.spliced(3, q, 2).sums[0], fingerprints.PrefixHash.of("abczc").sums[0])


def test_fingerprints_against_whole_span_sets(spark, docs, rows):
    """Likeness against exact span sets; extensions against the texts; equal texts, equal fingerprints; null ids last."""
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    follows = {i: order[(k + 1) % len(order)][1] or "" for k, (i, *_) in enumerate(order)}
    text = {i: t or "" for i, t, *_ in rows}
    spans = lambda t: {t[j : j + 16] for j in range(max(1, len(t) - 15))} if t else set()

    def share(a, b):
        x, y = spans(a), spans(b)
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    common = lambda a, b: len(os.path.commonprefix([a, b]))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for i, r in got.items():
        t, nxt = text[i], follows[i]
        q = len(t) // 3
        edited = t[: len(t) - q] + nxt[:q]
        if nxt != t:  # of repeated rows each follows the other
            assert r.lce_edited == common(t, edited) and r.lce_next == common(t, nxt)
        assert abs(r.near_edited - share(t, edited)) < 0.15 and abs(r.near_next - share(t, nxt)) < 0.15
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(text[i], r.fingerprint) == r.fingerprint
    alone = spark.createDataFrame([(None, "a b"), (None, None), (3, "c")], "doc_id long, text string")
    assert [(r.doc_id, r.n_chars) for r in fingerprints.fingerprints(alone).orderBy("n_chars").collect()] == [(None, 0), (3, 1), (None, 3)]
    assert fingerprints.fingerprints(alone.filter("doc_id is null")).count() == 2


def test_bpe_forgets_words_but_no_ids(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KNOWN", 5)
    path = vocabulary()
    want = Counter(len(encoder(path, public_tokenizers.PATTERN).encode_ordinary(t or "")) for _, t, *_ in rows)
    assert Counter(len(r.ids) for r in bpe.encoded(docs, path, public_tokenizers.PATTERN).collect()) == want
    one = bpe.digests(spark.createDataFrame([(None, "x y")], "doc_id long, text string"), path, public_tokenizers.PATTERN).first()
    assert one.doc_id is None and one.n_tokens == 2


def test_mixing_meets_budgets(docs, none):
    out = mixing.mixed(docs).toPandas()
    assert out.groupby("epoch").n_tokens.sum().sum() <= 2 * sum(len((t or "").split()) for t in _texts()) + 240
    assert set(out.epoch) <= {0, 1} and mixing.mixed(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() == len(out)


def test_water_filling_passes_shortage_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 1000), ("web", "en", "src1", 10), ("web", "de", "src2", 1000), ("other", "en", "zz", 5000)], "domain string, language string, src string, tokens long")
    mix = mixing.Mix(domains=(("web", 1, "^src"), ("other", 1, "")), languages={"en": 1, "de": 1}, most_epochs=1, per_mille=200)
    got = {(r.domain, r.language, r.src): r.budget for r in mixing.budgets(leaves, mix).collect()}
    # 1402 tokens: 701 a domain, 350 a language of web; src1 gives 10 and its sibling takes the rest
    assert got == {("web", "en", "src0"): 340, ("web", "en", "src1"): 10, ("web", "de", "src2"): 350, ("other", "en", "zz"): 701}


def _labelled(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        junk, toxic = i % 4 == 0, i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["idiot", "scum", "trash"])
        rows.append((i, " ".join(w + ("$$" if junk else "") for w in text) if not junk or not toxic else " ".join(f"{w} $$" for w in text)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_rows(spark, docs, rows, none):
    """Null, empty and very long texts, clashing columns, an empty table."""
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i, *_ in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    quality, toxic = quality_gbt.scored(docs, labels).collect(), toxicity.scored(docs, labels).collect()
    assert sorted(r.doc_id for r in quality) == sorted(r.doc_id for r in toxic) == sorted(i for i, *_ in rows)
    assert all(0 <= r.score <= 1 for r in [*quality, *toxic])
    assert quality_gbt.scored(none, labels).count() == 0 and toxicity.scored(none, labels).count() == 0
    assert token_counts.token_counts(none, vocabulary(), public_tokenizers.PATTERN, END_OF_DOCUMENT).count() == 0


def test_sample_keeps_its_bound_when_an_id_repeats(spark):
    """Ids 0, 1 and 8 may be learned from, 2 is held out, 7 has no document."""
    docs = spark.createDataFrame([(0, "b")] * 50 + [(0, "a"), (0, None), (1, None), (2, "c"), (8, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (7, 1), (8, 1), (None, 1)], "doc_id long, toxic int")
    got = samples.training_texts(docs, labels, "toxic", 10).select("doc_id", "text", "y").collect()
    assert sorted(map(tuple, got)) == [(0, "a", 1), (1, None, 0), (8, "c", 1)]


def test_toxic_kinds_are_learned():
    x = np.zeros((9, 6))
    x[:4, :3], x[4:7, 3:] = 1, 1
    x[8, 5] = 1
    assert toxicity._grouped(x, 2).tolist() == [0] * 4 + [1] * 3 + [-1, 1] or toxicity._grouped(x, 2).tolist() == [1] * 4 + [0] * 3 + [-1, 0]
    assert toxicity._grouped(np.zeros((0, 3)), 2).tolist() == [] and toxicity._grouped(np.ones((1, 3)), 2).tolist() == [0]


def test_classifiers_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    quality = quality_gbt.scored(docs, labels).collect()
    held = [r for r in quality if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in quality) and len(quality) == 601
    toxic = [r for r in toxicity.scored(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.toxic == truth[r.doc_id].toxic for r in toxic]) > 0.95
    assert {r.score for r in quality_gbt.scored(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert toxicity.scored(docs.limit(3), labels.limit(0)).count() == 3
