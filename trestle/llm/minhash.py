"""Near-duplicate documents by MinHash, exact in its links.

1. ``signed``: distinct k-word shingles of each text (64-bit hashes), their number, a 128-bit digest of the set, and
   the minima of many universal hashes (multiply-shift), 16 bits each.
2. Equal sets are one class, named by its smallest doc_id: a group of copies costs one row from here on.
3. Banding: bands of ``rows`` minima. Buckets with one class go. In the others signatures are compared, and pairs whose
   estimate is not clearly below the threshold are handed on as stars. Components of these stars (large-star,
   small-star) are candidate clusters: every link lies in one.
4. Inside clusters the intersections of the full sets are counted; components of the confirmed links are the result.

Comparing, in 3 and in 4, takes two steps. First each group's members meet its smallest class, in tiles that hold a
copy of it: as many rows as members, which settles groups that hold together. Then members outside of the smallest
class's component meet all others, in tiles of bounded size; members of one component are not compared again.

With 32 bands of 4 rows a pair at the threshold 0.8 misses all buckets once in 10**7; the estimate's margin is five
standard deviations. A bucket or cluster above a tile's size is split by hash into chunks, so that nothing is dropped and no
task grows.

Defined cases: null, empty or blank text has no shingles, is linked with nothing and kept; so is a row without doc_id;
equal rows (same doc_id) are one document; ties cannot occur, as the smallest doc_id stands for a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.components import components
from trestle.llm.hashing import U, mix, shingle_sets, slices
from trestle.llm.shared import cut, forget, nested, release

BANDS, ROWS, TILE = 32, 4, 256
#: Estimates below threshold - MARGIN are no candidates: 5 standard deviations of 128 minima at 0.8.
MARGIN = 0.18

SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, sig binary"


def _minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(len(starts), n) uint16: minima of n universal hashes over runs of ``values`` that begin at ``starts``."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = np.empty((len(starts), n), np.uint16)
    for k in range(n):
        # the low bits of a minimum are as good as new; the high ones are all near zero
        out[:, k] = np.minimum.reduceat((values * a[k] + b[k]) >> U(32), starts) & U(0xFFFF)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 400_000):
                sets, cuts = shingle_sets(batch.column(1), k)
                sizes = np.diff(cuts)
                some = np.flatnonzero(sizes)
                sums = np.zeros((2, len(sizes)), U)
                sig = np.zeros((len(sizes), BANDS * ROWS), np.uint16)
                if len(some):
                    sums[0, some] = np.add.reduceat(mix(sets ^ U(0x1234567)), cuts[some])
                    sums[1, some] = np.add.reduceat(mix(sets + U(0x9E3779B97F4A7C15)), cuts[some])
                    sig[some] = _minima(sets, cuts[some], BANDS * ROWS)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sig.shape[1] * 2), len(sizes), [None, pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), raw.cast(pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, SIGNED)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def bands(reps: DataFrame) -> DataFrame:
    """``key`` (band and its minima, hashed) and ``rep`` for each band of each class."""

    def band(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.ascontiguousarray(_signatures(batch.column(1)).reshape(-1, BANDS, ROWS)).view(np.uint64)[:, :, 0]
            key = mix(mix(sig) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(band, "key long, rep long")


#: Place of a row in its tile: compared with the rows on the right; on the right; on the right and settled.
LEFT, RIGHT, MAIN = 0, 1, 2
TILE_KEYS = ["key", "ci", "cj"]


def _sorted_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)


def star_tiles(rows: DataFrame) -> DataFrame:
    """Members (key, size, hub, rep, ..) in chunks of bounded size, each with a copy of the group's hub."""
    n = F.ceil(F.col("size") / TILE).cast("int")
    is_hub = F.col("rep") == F.col("hub")
    chunks = F.when(is_hub, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), n).cast("int")))
    split = rows.withColumn("ci", F.explode(chunks)).withColumns({"cj": F.lit(0), "label": F.col("rep"), "role": F.when(is_hub, LEFT).otherwise(MAIN)})
    return _sorted_tiles(split)


def open_members(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the groups that hold several components, without their hubs: ``label`` of the component, ``open`` (it
    isn't the hub's), and how many members there are (``n``) and are open (``o``)."""
    own = rows.select("key", "hub", "rep").join(comp.hint("merge"), F.col("rep") == F.col("node"), "left").select("key", "hub", "rep", F.coalesce("component", "rep").alias("label"))
    size = own.groupBy("key").agg(F.max(F.struct(F.col("rep") == F.col("hub"), "label"))["label"].alias("main"), F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = size.filter("lo <> hi").select(F.col("key").alias("k2"), "main", (F.col("n") - 1).alias("n"))
    rest = own.filter("rep <> hub").join(mixed.hint("merge"), F.col("key") == F.col("k2")).select("key", "rep", "label", "n", (F.col("label") != F.col("main")).alias("open"))
    some = rest.filter("open").groupBy("key").agg(F.count("*").alias("o")).select(F.col("key").alias("k2"), "o")
    return rest.join(some.hint("merge"), F.col("key") == F.col("k2")).select("key", "rep", "label", "open", "n", "o")


def open_tiles(rows: DataFrame) -> DataFrame:
    """Each open member meets every other member of its group in one tile (chunk of the open ones, chunk of all)."""
    n, o = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n", "o"))
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    at = lambda k: F.array(F.pmod(F.xxhash64("rep"), k).cast("int"))
    place = lambda ci, cj, role: F.struct(ci.alias("ci"), cj.alias("cj"), F.lit(role).alias("role"))
    left = F.transform(upto(n), lambda j: place(F.get(at(o), 0), j, LEFT))
    right = lambda role: F.transform(upto(o), lambda i: place(i, F.get(at(n), 0), role))
    split = rows.withColumn("p", F.explode(F.when(F.col("open"), F.concat(left, right(RIGHT))).otherwise(right(MAIN))))
    return _sorted_tiles(split.select("*", "p.ci", "p.cj", "p.role").drop("p"))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int = 3) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' first rows, from batches sorted by the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys)]
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        last = int(np.argmax(same))  # sorted: the last group is the tail of the batch
        if held and last:
            yield _table([*held, batch.slice(0, last)], n_keys)
            held = []
        elif held:
            before = held[-1]
            if any(before.column(c)[-1] != batch.column(c)[0] for c in range(n_keys)):
                yield _table(held, n_keys)
                held = []
        elif last:
            yield _table([batch.slice(0, last)], n_keys)
        held.append(batch.slice(last))
    if held:
        yield _table(held, n_keys)


def _table(batches: list[pa.RecordBatch], n_keys: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in range(n_keys):
        k = t.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return t, np.append(np.flatnonzero(new), t.num_rows)


def _stars(rep: np.ndarray, hits: Iterator[tuple[int, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Components of the graph whose edges are i - j for (i, [j, ...]), as edges from each class to the smallest.

    Buckets of one group mostly share their smallest class, so that their edges are mostly the same.
    """
    parent = list(range(len(rep)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in hits:
        for j in js:
            a, b = root(i), root(int(j))
            if rep[a] > rep[b]:
                a, b = b, a
            parent[b] = a
    roots = np.array([root(i) for i in range(len(rep))])
    own = np.flatnonzero(rep[roots] != rep)
    return rep[own].tolist(), rep[roots[own]].tolist()


def _edges(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _compared(batches: Iterator[pa.RecordBatch], prepare) -> Iterator[pa.RecordBatch]:
    """Stars of the pairs that are near in each tile (key, ci, cj, role, label, rep, ..). ``prepare`` makes, for rows a to
    b of a table, a function from a row and others to those near it."""
    for t, cuts in _groups(batches):
        role, label, rep = (t.column(c).to_numpy() for c in ("role", "label", "rep"))
        u, v = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r, o, own = rep[a:b], role[a:b], label[a:b]
            left, right = np.flatnonzero(o == LEFT), np.flatnonzero(o != LEFT)
            if not len(left) or not len(right):
                continue
            near = prepare(t, a, b)

            def hits(r=r, o=o, own=own, left=left, right=right, near=near):
                for i in left:
                    # of two open members that one asks which has the smaller name
                    js = right[(own[right] != own[i]) & ((o[right] == MAIN) | (r[right] > r[i]))]
                    if len(js):
                        yield i, near(i, js)

            us, vs = _stars(r, hits())
            u += us
            v += vs
        yield _edges(u, v)


def candidates(tiles: DataFrame, threshold: float) -> DataFrame:
    """Stars of the classes of a tile whose signatures agree well enough."""
    least = int(np.ceil((threshold - MARGIN) * BANDS * ROWS))

    def prepare(t: pa.Table, a: int, b: int):
        sig = _signatures(t.column("sig").slice(a, b - a))
        return lambda i, js: js[(sig[js] == sig[i]).sum(1) >= least]

    def compare(batches):
        return _compared(batches, prepare)

    return tiles.select(*TILE_KEYS, "role", "label", "rep", "sig").mapInArrow(compare, "u long, v long")


def confirmed(tiles: DataFrame, k: int, percent: int) -> DataFrame:
    """Stars of the links 100 * |A & B| >= percent * |A | B| in each tile, on full sets."""

    def prepare(t: pa.Table, a: int, b: int):
        sets, ends = shingle_sets(t.column("text").slice(a, b - a).combine_chunks(), k)
        sizes = np.diff(ends)
        some = np.flatnonzero(sizes)
        own = np.zeros(len(sizes), U)
        if len(some):
            own[some] = np.add.reduceat(mix(sets ^ U(0x1234567)), ends[some])
        # a row whose set isn't its class's set came from another text under the same doc_id
        usable = (sizes > 0) & (own.view(np.int64) == t.column("s1").to_numpy()[a:b])
        ids = np.unique(sets, return_inverse=True)[1]
        mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)

        def near(i: int, js: np.ndarray) -> np.ndarray:
            if not usable[i]:
                return js[:0]
            small, large = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
            rest = js[usable[js] & (100 * small >= percent * large)]
            mine = ids[ends[i] : ends[i + 1]]
            mark[mine] = 1
            both = np.array([mark[ids[ends[j] : ends[j + 1]]].sum() for j in rest], np.int64)
            mark[mine] = 0
            return rest[100 * both >= percent * (sizes[rest] + sizes[i] - both)]

        return near

    def confirm(batches):
        return _compared(batches, prepare)

    return tiles.select(*TILE_KEYS, "role", "label", "rep", "s1", "text").mapInArrow(confirm, "u long, v long")


def _grouped(met: DataFrame, payload, compare, label: str) -> DataFrame:
    """Components of the near pairs in the groups ``met`` (key, size, hub, rep): hubs first, then what they left open.
    ``payload`` joins what ``compare`` reads to rows with a ``rep``."""
    comp = components(compare(star_tiles(payload(met))), label)
    rest = cut(open_members(met, comp), f"{label}-open")
    if not rest.limit(1).count():
        forget(rest)
        return comp
    more = compare(open_tiles(payload(rest)))
    out = components(more.union(comp.select("node", "component")), label)
    forget(rest, comp)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable) and ``kept`` of every document."""
    sign = cut(signed(docs, k), "minhash-signed")
    classes = sign.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = cut(classes, "minhash-classes")
    keys = bands(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).filter("size > 1")
    met = keys.join(shared.select(F.col("key").alias("k2"), "size", "hub").hint("merge"), F.col("key") == F.col("k2")).select("key", "size", "hub", "rep")
    met = cut(met, "minhash-met")
    signs = reps.select(F.col("rep").alias("r2"), "sig")
    with_sig = lambda rows: rows.join(signs.hint("merge"), F.col("rep") == F.col("r2")).drop("r2")
    clusters = _grouped(met, with_sig, lambda tiles: candidates(tiles, percent / 100), "minhash-clusters")
    forget(met)
    member = clusters.union(clusters.select("component", "component")).distinct().toDF("rep", "key")
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).select(F.col("key").alias("k2"), "size")
    # a cluster is named by its smallest class
    member = member.join(sizes, F.col("key") == F.col("k2")).select("rep", "key", "size", F.col("key").alias("hub"))
    member = cut(member, "minhash-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("d2"), F.col("text").cast("string").alias("text"))
    # one plan at every size: never a broadcast that turns into a shuffle as the members grow; texts cross once
    own = member.select("rep").join(reps.select(F.col("rep").alias("r2"), "s1").hint("merge"), F.col("rep") == F.col("r2")).select("rep", "s1")
    held = cut(own.join(texts.hint("merge"), F.col("rep") == F.col("d2")).select(F.col("rep").alias("r2"), "s1", "text"), "minhash-texts")
    release(docs.sparkSession)
    with_text = lambda rows: rows.join(held.hint("merge"), F.col("rep") == F.col("r2")).drop("r2")
    found = _grouped(member, with_text, lambda tiles: confirmed(tiles, k, percent), "minhash-components")
    forget(member, clusters, held)
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), F.coalesce("component", "rep").alias("component_id")
    )
    named = cut(named, "minhash-named")
    same = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn"))
    out = sign.select("doc_id", "n_shingles", "s1", "s2").join(named.hint("merge"), same, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, all columns as given; repeated rows of a doc_id are one."""
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    d = nested(docs)
    return d.join(gone, F.col("d.doc_id") == F.col("gone_id"), "left_anti").select("d.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[][] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT x AS node, y AS seen FROM e UNION SELECT y, x FROM e),
walk AS (SELECT node, seen FROM r UNION SELECT walk.node, r.seen FROM walk JOIN r ON walk.seen = r.node),
c AS (SELECT node, least(node, min(seen)) AS component FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id)::BIGINT AS component_id,
  coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
