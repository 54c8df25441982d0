"""The pipeline against a brute-force version of its five stages, and its stages on odd rows."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from trestle.llm import mixing  # noqa: E402
from trestle.llm.queries import vocabulary  # noqa: E402
from trestle.llm.vocab import encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    line = lambda n=20: " ".join(word() for _ in range(n))
    texts = [None, "", "too few words", "word word word word word " * 6, "## $$ " * 30 + line()]
    licence = line()
    for _ in range(12):
        texts.append("\n".join([line(), licence, line(), " "]))
    base = [word() for _ in range(120)]
    wrapped = lambda ws, n, at: "\n".join([" ".join(ws[:at]), *[" ".join(ws[k : k + n]) for k in range(at, len(ws), n)]])
    changed = [*base[:60], "changed", *base[61:]]
    texts += [wrapped(base, 40, 40), wrapped(changed, 40, 20), licence, texts[6], texts[7].replace(" ", "  ", 1)]
    return [(100 - i, t, ["en", "de", "fr"][i % 3], ["src0", "src12", "other"][i % 3], len(t or "")) for i, t in enumerate(texts)]


def _fails(text):
    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    window = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if window[tuple(words[i : i + 5])] > 1 for k in range(5)}
    chars, symbols = sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>")
    dup = len(lines) - len(set(lines))
    return (
        len(words) < 10 or 100 * len(repeated) > 20 * len(words) or 10 * symbols > len(words) or 100 * dup > 30 * len(lines)
        or chars < 2 * len(words) or chars > 25 * len(words)
    )


def _grouped(names, near):
    """Least name of each component of all pairs."""
    label = {x: x for x in names}
    for _ in names:
        for a in names:
            for b in names:
                if near(a, b):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def _deduplicated(docs):
    places = {}
    for i, t, *_ in docs:
        for k, raw in enumerate(t.split("\n")):
            if raw.strip(" \t\v\f\r"):
                places.setdefault(raw.strip(" \t\v\f\r").lower(), []).append((i, k))
    sets = {x: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in places}
    label = _grouped(list(places), lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    first = {}
    for x, own in places.items():
        first[label[x]] = min([*own, first.get(label[x], own[0])])
    gone = {p for x, own in places.items() for p in own if p != first[label[x]]}
    for i, t, *rest in docs:
        now = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if now == t or now.strip():
            yield (i, now, *rest[:2], len(now) if now != t else rest[2])


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [r for r in rows if not _fails(r[1] or "")]
    docs = list(_deduplicated(docs))
    sets = {r[0]: {tuple(r[1].lower().split()[k : k + 5]) for k in range(len(r[1].split()) - 4)} or {tuple(r[1].lower().split())} for r in docs}
    label = _grouped(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    kept = [r for r in docs if label[r[0]] == r[0]]
    assert len(rows) > len(docs) > len(kept) > 10
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    times = Counter(i for (i,) in con.execute(f"SELECT doc_id FROM ({mixing.SQL})").fetchall())
    own, sha = encoder(vocabulary(), public_tokenizers.PATTERN), lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in kept:
        ids = own.encode_ordinary(t)
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))] += times[i]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +want


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, extra columns of clashing names, an empty table."""
    more = "doc_id long, text string, lang string, source string, n_chars long, removed int, kept boolean, d string, h1 long, rep long, epoch int, tokens long"
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None, None, None, 1, True, "d", 2, 3, 4, 5), (1, text, None, None, None, 1, True, "d", 2, 3, 4, 5), (None, text + " more words here", "en", "src0", 3, None, None, None, None, None, None, None), (2, None, None, None, None, 1, None, "", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, more)
    for data in (docs, docs.limit(0)):
        now = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == data.columns, name
            now.collect()
    data.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
