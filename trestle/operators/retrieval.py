"""Character-gram retrieval: postings, document frequency, rarity score, top-k evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.functions.text import GRAM_SIZES, ngrams
from trestle.operators.pairing import checkpointed

#: Scores are whole numbers: parts of SCALE per gram, so that sums don't depend on their order.
SCALE = 1_000_000_000_000
#: Grams of the queries that are looked for in one pass over the blocks, and cells of the table of queries by grams.
MOST_GRAMS, MOST_CELLS = 100_000, 1 << 24
#: Grams that make the dense part of a score.
DENSE = 512
#: Cells of one table from beginnings to longer ones.
MOST_STEPS = 1 << 22
#: Passes; more queries than that are joined with the postings instead.
MOST_PASSES = 20
#: Characters of blocks that are looked at together.
PIECE = 1 << 20
QUOTE = 1200
TOKEN = re.compile(r"[a-z0-9_+.-]{2,}")


def postings(blocks: DataFrame) -> DataFrame:
    """``gram``, ``report_id``, ``block_pos``: one row per distinct gram of a block."""
    return blocks.select("report_id", "block_pos", F.explode(ngrams(F.col("text"))).alias("gram"))


class GramTable:
    """Where given grams occur in many texts at once, exactly: the grams' characters are numbered, and tables lead from
    the number of a beginning and the next character to that of the longer beginning; where a table would be large, it is
    a sorted list. Longer grams are tokens, told by their text."""

    def __init__(self, grams: list[str]):
        self.size = len(grams)
        short = [(g, k) for k, g in enumerate(grams) if len(g) <= max(GRAM_SIZES)]
        letters = sorted({ord(c) for g, _ in short for c in g})
        self.base = len(letters) + 1
        self.letters = np.zeros(0x110000, np.int32)
        self.letters[letters] = np.arange(1, self.base)
        self.steps, self.ids, nodes = [], [], {chr(c): i + 1 for i, c in enumerate(letters)}
        for n in range(2, max(GRAM_SIZES) + 1):
            longer = {p: i + 1 for i, p in enumerate(sorted({g[:n] for g, _ in short if len(g) >= n}))}
            at = np.array([nodes[p[:-1]] * self.base + self.letters[ord(p[-1])] for p in longer], np.int64)
            if (len(nodes) + 1) * self.base <= MOST_STEPS:
                table = np.zeros((len(nodes) + 1) * self.base, np.int32)
                table[at] = np.arange(1, len(longer) + 1)
                self.steps.append((None, table))
            else:
                order = np.argsort(at)
                self.steps.append((at[order], (order + 1).astype(np.int32)))
            ids = np.full(len(longer) + 1, -1, np.int64)
            for g, k in short:
                if len(g) == n:
                    ids[longer[g]] = k
            self.ids.append(ids)
            nodes = longer
        self.tokens = {g: k for k, g in enumerate(grams) if len(g) > max(GRAM_SIZES)}
        self.shortest = min(map(len, self.tokens), default=0)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, gram) of every gram that a compact text has, ascending, each once."""
        # no gram has a line's end in it, nor begins with nothing
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.uint32 if len(texts) * self.size < 1 << 32 else np.int64
        numbers = np.where(points == 10, np.int32(0), self.letters[points])
        owner = np.repeat(np.arange(len(texts), dtype=kind), [len(t) + 1 for t in texts])
        pairs, node = [np.empty(0, kind)], numbers
        for (keys, table), ids in zip(self.steps, self.ids, strict=True):
            node, numbers = node[:-1], numbers[1:]
            key = (node if keys is None else node.astype(np.int64)) * self.base + numbers
            if keys is None:
                node = np.where(numbers > 0, table[key], 0)
            elif len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                node = np.where((keys[at] == key) & (numbers > 0) & (node > 0), table[at], 0)
            else:
                node = np.zeros(len(key), np.int32)
            start = np.flatnonzero(node)
            gram = ids[node[start]]
            if (ids[1:] < 0).any():
                start, gram = start[gram >= 0], gram[gram >= 0]
            pairs.append(owner[start] * kind(self.size) + gram.astype(kind))
        if self.tokens:
            whole = [(i, self.tokens[x]) for i, t in enumerate(texts) if len(t) >= self.shortest for x in TOKEN.findall(t) if x in self.tokens]
            pairs.append(np.array([i * self.size + k for i, k in whole], kind))
        both = np.sort(np.concatenate(pairs))
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        block = both // kind(max(1, self.size))
        return block.astype(np.int64), (both - block * kind(self.size)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with a bounded number of characters, one row at least, and the compact texts of their first
    column, which are in small letters; Python's white space is that of :func:`compact`."""
    for batch in batches:
        texts = ["".join((t or "").split()) for t in batch.column(0).to_pylist()]
        lo, size = 0, 0
        for hi, t in enumerate(texts):
            if hi > lo and size + len(t) > PIECE:
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0
            size += len(t)
        if len(texts) > lo:
            yield batch.slice(lo), texts[lo:]


def frequencies(lowered: DataFrame, names: list[str]) -> np.ndarray:
    """In how many blocks (column ``c``, in small letters) each gram occurs. One number a gram comes back to the driver."""

    def count(batches):
        grams = GramTable(names)
        total = np.zeros(grams.size, np.int64)
        for _, texts in _pieces(batches):
            total += np.bincount(grams.found(texts)[1], minlength=grams.size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(len(names), np.int64)
    for row in lowered.select("c").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


class Weights:
    """Scores of texts for many queries: grams that many texts and queries share make a dense product, the others are
    added one by one. Whole numbers below 2 ** 53 add up exactly as floats in any order; larger ones stay integers."""

    def __init__(self, asked: list[tuple[object, list[int]]], weights: np.ndarray, df: np.ndarray):
        self.n, kind = len(asked), np.float64 if max(int(weights[own].sum()) for _, own in asked) < 1 << 53 else np.int64
        gram, q = (np.concatenate(x) for x in zip(*[(np.array(own, np.int64), np.full(len(own), k, np.int64)) for k, (_, own) in enumerate(asked)], strict=True))
        order = np.argsort(gram, kind="stable")
        self.q, self.weights = q[order], weights.astype(kind)
        self.first = np.searchsorted(gram[order], np.arange(len(weights) + 1))
        often = np.argsort(-df * np.diff(self.first), kind="stable")[:DENSE]
        self.place = np.full(len(weights), -1, np.int64)
        self.place[often] = np.arange(len(often))
        self.cells = np.zeros((len(often), self.n), kind)
        at = self.place[gram]
        self.cells[at[at >= 0], q[at >= 0]] = self.weights[gram[at >= 0]]

    def scores(self, block: np.ndarray, gram: np.ndarray, size: int) -> np.ndarray:
        """Texts by queries, from the (text, gram) that occur."""
        at = self.place[gram]
        has = np.zeros((size, len(self.cells)), self.cells.dtype)
        has[block[at >= 0], at[at >= 0]] = 1
        out = (has @ self.cells).astype(np.int64)
        block, gram, flat = block[at < 0], gram[at < 0], out.reshape(-1)
        times = self.first[gram + 1] - self.first[gram]
        ends = np.cumsum(times)
        lo = 0
        while lo < len(gram):
            # some millions of additions together
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 22))))
            n = times[lo:hi]
            item = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[gram[lo:hi]], n)
            cell, each = np.repeat(block[lo:hi] * self.n, n) + self.q[item], np.repeat(self.weights[gram[lo:hi]], n)
            if each.dtype == np.float64:
                base = block[lo] * self.n
                sums = np.bincount(cell - base, each).astype(np.int64)
                flat[base : base + len(sums)] += sums
            else:
                np.add.at(flat, cell, each)
            lo = hi
        return out


def _best(lowered: DataFrame, names: list[str], asked: list[tuple[object, list[int]]], df: np.ndarray, k: int) -> DataFrame:
    """``q`` (number of the query), report_id, block_pos, score: the best blocks of each piece, for each query, but those
    that ``k`` blocks of the task are better than."""
    schema = f"q int, report_id {lowered.schema['report_id'].dataType.simpleString()}, block_pos {lowered.schema['block_pos'].dataType.simpleString()}, score long"

    def score(batches):
        grams, least = GramTable(names), np.ones(len(asked), np.int64)
        table = Weights(asked, np.where(df > 0, SCALE // np.maximum(df, 1), 0), df)
        for batch, texts in _pieces(batches):
            order = pa.compute.sort_indices(batch, [(batch.schema.names[1], "ascending"), (batch.schema.names[2], "ascending")])
            batch, texts = batch.take(order), [texts[i] for i in order.to_pylist()]
            sums = table.scores(*grams.found(texts), len(texts))
            if len(texts) > k:
                least = np.maximum(least, np.partition(sums, len(texts) - k, axis=0)[len(texts) - k])
            at, q = np.nonzero(sums >= least)
            value = sums[at, q]
            # of equal scores the first block wins
            best = np.lexsort((at, -value, q))
            first = np.searchsorted(q[best], np.arange(len(asked)))
            best = best[np.arange(len(best)) - first[q[best]] < k]
            picked = pa.array(at[best])
            yield pa.RecordBatch.from_arrays([pa.array(q[best], pa.int32()), batch.column(1).take(picked), batch.column(2).take(picked), pa.array(value[best])], names=["q", "report_id", "block_pos", "score"])

    return lowered.select("c", "report_id", "block_pos").mapInArrow(score, schema)


def write_index(blocks: DataFrame, path: str) -> None:
    """Postings clustered by gram, and blocks, both as Parquet with the format's version."""
    postings(blocks).repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")
    blocks.withColumn("version", F.lit("ngram-index.v1")).write.mode("overwrite").parquet(f"{path}/blocks")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    blocks = spark.read.parquet(f"{path}/blocks")
    if blocks.filter(F.col("version").isNull() | (F.col("version") != "ngram-index.v1")).limit(1).count():
        raise ValueError("unknown index version")
    return blocks.drop("version"), spark.read.parquet(f"{path}/postings")


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("gram").agg(F.count("*").alias("df"))


def _tallied(batches, grams_of) -> Iterator[pa.RecordBatch]:
    """``gram``, ``n``: in how many texts; handed on now and then, so that a task holds a bounded number of grams."""
    seen: dict[str, int] = {}
    told = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])
    for _, texts in _pieces(batches):
        for g, n in grams_of(texts):
            seen[g] = seen.get(g, 0) + n
        if len(seen) > MOST_GRAMS:
            yield told()
            seen.clear()
    yield told()


def _told_apart(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and in how many texts each occurs."""
    order = np.lexsort((owner, key))
    owner, key = owner[order], key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    once = new | np.append(True, owner[1:] != owner[:-1])[: len(key)]
    starts = np.flatnonzero(new)
    return key[starts], np.add.reduceat(once.astype(np.int64), starts) if len(starts) else starts


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each behind its text by a line's end, and the number of their text."""
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def _pairs_of(texts: list[str]) -> Iterator[tuple[str, int]]:
    points, owner = _points(texts)
    at = np.flatnonzero((points[:-1] != 10) & (points[1:] != 10))
    keys, n = _told_apart(owner[at], points[at] << 21 | points[at + 1])
    return ((chr(k >> 21) + chr(k & 0x1FFFFF), c) for k, c in zip(keys.tolist(), n.tolist(), strict=True))


def _longer_of(texts: list[str], pairs: set[str], letters: str) -> Iterator[tuple[str, int]]:
    """Grams of three and four characters, and longer tokens, of frequent pairs only."""
    points, owner = _points(texts)
    table = np.zeros(0x110000, np.int64)
    table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    base, numbers = len(letters) + 1, table[points]
    known = np.array(sorted((letters.index(p[0]) + 1) * base + letters.index(p[1]) + 1 for p in pairs), np.int64)
    key = numbers[:-1] * base + numbers[1:]
    good = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    for size in (3, 4):
        m = len(good) - size + 2
        if m > 0:
            at = np.flatnonzero(np.logical_and.reduce([good[i : i + m] for i in range(size - 1)]))
            whole = numbers[at]
            for i in range(1, size):
                whole = whole * base + numbers[at + i]
            for k, c in zip(*(x.tolist() for x in _told_apart(owner[at], whole)), strict=True):
                yield "".join(letters[k // base**i % base - 1] for i in reversed(range(size))), c
    for t in texts:
        for x in {x for x in TOKEN.findall(t) if len(x) > max(GRAM_SIZES) and all(x[i : i + 2] in pairs for i in range(len(x) - 1))}:
            yield x, 1


def top_grams(blocks: DataFrame, n: int) -> DataFrame:
    """``gram``, ``df``: the ``n`` grams that most blocks have, by df and gram.

    A block that has a gram has all pairs of characters in it: pairs are counted first, all of them, and then only the
    longer grams whose pairs are each as frequent as the n-th pair. Postings are never made.
    """
    lowered = blocks.select(F.lower("text").alias("c"))
    count = lambda grams_of: lowered.mapInArrow(lambda batches: _tallied(batches, grams_of), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))
    pairs = checkpointed(count(_pairs_of))
    first = pairs.orderBy(F.desc("df")).limit(n).collect()
    least = first[-1]["df"] if len(first) == n else 1
    frequent = pairs.filter(F.col("df") >= least)
    known = {r["gram"] for r in frequent.select("gram").collect()}
    letters = "".join(sorted(set("".join(known))))
    found = frequent
    if known:
        if (len(letters) + 1) ** max(GRAM_SIZES) >= 1 << 63:
            found = document_frequency(postings(blocks))
        else:
            found = frequent.unionByName(count(lambda texts: _longer_of(texts, known, letters)))
    return found.orderBy(F.desc("df"), "gram").limit(n)


def search_batch(blocks: DataFrame, queries: DataFrame, k: int = 8, within: str | None = None, posts: DataFrame | None = None) -> DataFrame:
    """The ``k`` best blocks of each query (``query_id``, ``query``): ``query_id``, rank, report_id, block_pos, score.

    Frequencies count all blocks, also when ``within`` restricts the results to one report. Without an index (``posts``)
    the grams of a bounded set of queries are looked for in all blocks at once, and only the best blocks of each task
    leave it: postings are never made, nor joined on frequent grams. With an index, or for more queries than
    ``MOST_PASSES`` passes take, the postings of the queries' grams are joined; the results are the same.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "report_id", "block_pos")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    grams = queries.select("query_id", F.explode(ngrams(F.col("query"))).alias("g"))
    if posts is None:
        size = grams.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).first()
        # every pass may hold all its grams apart
        passes = max(1, -(-size["n"] // MOST_GRAMS), -(-(size["n"] * size["q"]) // (MOST_CELLS * max(1, size["q"] // 400))))
        if passes <= MOST_PASSES:
            parts = [_search_pass(blocks, grams.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p), k, within) for p in range(passes)]
            return ranked(reduce(DataFrame.unionByName, [x for x in parts if x is not None] or [_none(blocks, grams)]))
        posts = postings(blocks)
    hit = posts.join(grams.select("g").distinct(), F.col("gram") == F.col("g"), "left_semi")
    df = document_frequency(hit).select(F.col("gram").alias("g2"), "df")
    kept = hit if within is None else hit.filter(F.col("report_id") == within)
    score = F.sum(F.expr(f"{SCALE} div df"))
    return ranked(kept.join(df, F.col("gram") == F.col("g2")).join(grams, F.col("gram") == F.col("g")).groupBy("query_id", "report_id", "block_pos").agg(score.alias("score")))


def _none(blocks: DataFrame, grams: DataFrame) -> DataFrame:
    return grams.select("query_id").limit(0).crossJoin(blocks.select("report_id", "block_pos").limit(0)).withColumn("score", F.lit(0).cast("long"))


def _search_pass(blocks: DataFrame, grams: DataFrame, k: int, within: str | None) -> DataFrame | None:
    """The best blocks, by piece, for a bounded number of queries; None if they have no grams."""
    asked: dict = {}
    for row in grams.collect():
        asked.setdefault(row["query_id"], []).append(row["g"])
    if not asked:
        return None
    names = sorted({g for own in asked.values() for g in own})
    place = {g: i for i, g in enumerate(names)}
    lowered = blocks.select(F.lower("text").alias("c"), "report_id", "block_pos")
    n = frequencies(lowered, names)
    numbered = [(q, [place[g] for g in own]) for q, own in asked.items()]
    best = _best(lowered if within is None else lowered.filter(F.col("report_id") == within), names, numbered, n, k)
    ids = blocks.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(numbered)], f"q2 int, query_id {grams.schema['query_id'].dataType.simpleString()}")
    return best.join(F.broadcast(ids), F.col("q") == F.col("q2")).select("query_id", "report_id", "block_pos", "score")


def search(blocks: DataFrame, query: str, k: int = 8, within: str | None = None, posts: DataFrame | None = None) -> DataFrame:
    one = blocks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    return search_batch(blocks, one, k, within, posts).drop("query_id")


def evidence(blocks: DataFrame, hits: DataFrame, few: bool = False) -> DataFrame:
    """Hits with their source and quote; always with the report, as ``source_id`` repeats between reports. ``few`` hits
    are handed to all tasks, so that the blocks aren't shuffled."""
    hits = F.broadcast(hits) if few else hits
    side = blocks.select(F.col("report_id").alias("r2"), F.col("block_pos").alias("p2"), "source_id", F.substring("text", 1, QUOTE).alias("quote"))
    return hits.join(side, (F.col("report_id") == F.col("r2")) & (F.col("block_pos") == F.col("p2"))).drop("r2", "p2")


def context_lines(found: DataFrame) -> Column:
    """``[source] quote`` lines in rank order, for an aggregation."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("source_id"), F.lit("] "), F.col("quote")).alias("line"))))
    return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
