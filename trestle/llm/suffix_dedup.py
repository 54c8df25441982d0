"""Removal of byte strings that repeat across a corpus, for every 200-byte string.

Exact but for collisions of hashes: contexts count as equal if the hash of the gram and the hash of the whole context
(64 bits each) agree, and so do single windows in what is left of very large groups; all else is compared by bytes.

1. Anchors: of each 200-byte window the 32-byte gram with the least hash. Equal windows have equal anchors at the same
   place, and the windows of one anchor follow each other. A text leaves one row per anchor (about one per 85 bytes):
   the gram's hash, the hash of all that its windows cover (its context), and where that is.
2. Grams found once hold no repeat. Contexts found twice repeat as a whole. What is left are contexts that share a
   gram and differ somewhere: the rims of repeated passages. Of a window's 168 bytes around its gram, 84 lie on one
   side: contexts meet only where they share the gram with the 84 bytes before it, or behind it.
3. Groups of such contexts are sorted by suffix: the linear grouping construction (``suffix_array``) over the group's
   contexts end to end, then neighbours are compared. A window repeats if a neighbour shares 200 bytes.
   Groups of more than ``MOST_CONTEXTS`` (a passage that very many documents share) are not put into one task: each
   context is compared with the group's most frequent one around the gram, byte for byte. The windows that differ from
   it meet again by finer places, ``FINER`` at a time, in groups that share all but 11 of 200 bytes; what is still in
   a very large group after that meets window by window.
4. Covered bytes are merged per document, and removed.

Strings are judged on the input; matches never cross documents. Defined cases: null text is the empty text; texts
under 200 bytes lose nothing; a text of 2**28 bytes or more is an error; equal rows repeat each other; overlapping repeats within a text count; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.hashing import _VALUES, U, mix, powers
from trestle.llm.shared import cut, text_of

SIZE, GRAM, MOST_CONTEXTS, FINER = 200, 32, 100, 12
_POS_BITS = 28  # a text has less than 2**28 bytes; the hash of a gram keeps 36 bits when grams of a window are compared
_BASE = 0x9E3779B97F4A7C15


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a sequence of positive numbers, by groups of equal Lyndon prefixes.

    Groups begin as the sets of suffixes with the same first number. From the largest down, each suffix of a group
    finds its previous smaller one (the nearest on the left in a group not yet taken); those found leave their group
    for a new one right above it, the more often found the higher. In the end groups are ordered by Lyndon prefix, and
    a pass upwards puts each suffix in its place: behind the sorted suffix to its right, along the pointers.
    """
    n = len(s)
    if not n:
        return []
    by_value: dict[int, list[int]] = {}
    for i, v in enumerate(s):
        by_value.setdefault(v, []).append(i)
    values = sorted(by_value)
    # a group's list may name suffixes that have left it since; ``size`` counts those that are in it
    members, size = [by_value[v] for v in values], [len(by_value[v]) for v in values]
    rank = {v: g for g, v in enumerate(values)}
    group = [rank[v] for v in s]
    below, above = list(range(-1, len(values) - 1)), [*range(1, len(values)), -1]
    taken, prev, g = [False] * n, [-1] * n, len(values) - 1

    def leave(old: int, js: list[int]) -> None:
        fresh, up = len(size), above[old]
        members.append(js)
        size.append(len(js))
        size[old] -= len(js)
        below.append(old)
        above.append(up)
        above[old] = fresh
        if up >= 0:
            below[up] = fresh
        for j in js:
            group[j] = fresh

    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if len(own) == 1:
            i = own[0]
            taken[i] = True
            j = i - 1
            while j >= 0 and taken[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[group[j]] > 1:
                leave(group[j], [j])
            g = below[g]
            continue
        own.sort()
        for i in own:
            taken[i] = True
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[tuple[int, int], list[int]] = {}
        for j, t in times.items():
            by_times.setdefault((t, group[j]), []).append(j)
        for (_, old), js in sorted(by_times.items(), reverse=True) if len(by_times) > 1 else by_times.items():
            if len(js) < size[old]:  # else all of the group would move right above its own place
                leave(old, js)
        g = below[g]
    start, at, g = [0] * len(size), 0, 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    out, placed = [-1] * n, [False] * n

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            out[start[group[j]]] = j
            start[group[j]] += 1
            placed[j] = True
            j = prev[j]

    place(n - 1)
    for k in range(n):
        place(out[k] - 1)
    return out


def repeats(contexts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each context, the starts of its ``size``-byte strings that start anywhere else in the contexts, too."""
    data = b"\0".join(contexts) + b"\0"
    ends = np.repeat(np.cumsum([len(c) + 1 for c in contexts]) - 1, [len(c) + 1 for c in contexts])
    s = np.frombuffer(data, np.uint8).astype(np.int64) + 2
    s[np.cumsum([len(c) + 1 for c in contexts]) - 1] = 1
    order = np.array(suffix_array(s.tolist()), np.int64)
    whole = ends - np.arange(len(s)) >= size
    hit = np.zeros(len(s), bool)
    near = np.flatnonzero(whole[order[:-1]] & whole[order[1:]])
    for i, j in zip(order[near].tolist(), order[near + 1].tolist(), strict=True):
        if data[i : i + size] == data[j : j + size]:
            hit[i] = hit[j] = True
    out, at = [], 0
    for c in contexts:
        out.append(np.flatnonzero(hit[at : at + len(c)]))
        at += len(c) + 1
    return out


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[data] * powers(len(data)), out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total), pow(_BASE, -1, 2**64))[start] + (end - start).astype(U))


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, first window, last window, gram's place in the context) for each anchor of a text."""
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < SIZE:
        return none.astype(U), none.astype(U), none, none, none
    if n >= 1 << _POS_BITS:
        raise ValueError(f"a text of {n} bytes; places are numbered up to {1 << _POS_BITS}")
    total = _sums(np.frombuffer(raw, np.uint8))
    at = np.arange(n - GRAM + 1)
    gram = _hashes(total, at, at + GRAM)
    w = SIZE - GRAM + 1
    v = ((gram >> U(_POS_BITS)) << U(_POS_BITS)) | at.astype(U)
    pad = np.full(-len(v) % w, U(2**64 - 1))
    rows = np.concatenate([v, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = n - SIZE + 1
    least = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U((1 << _POS_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    final = np.append(first[1:], m) - 1
    a = least[first]
    context = mix(_hashes(total, first, final + SIZE) + (a - first).astype(U) * U(0xD1342543DE82EF95))
    return gram[a], context, first, final, a - first


_ROW = "key long, ctx long, doc_id long, th long, lo int, hi int, mid int"


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("raw"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                found = [anchors(r) for r in piece.column(2).to_pylist()]
                sizes = np.array([len(f[2]) for f in found], np.int64)
                cols = [np.concatenate([f[k] for f in found]) for k in range(5)]
                own = np.repeat(np.arange(len(found)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), piece.column(0).take(pa.array(own)), piece.column(1).take(pa.array(own)),
                     *[pa.array(cols[k].astype(np.int32)) for k in (2, 3, 4)]], names=["key", "ctx", "doc_id", "th", "lo", "hi", "mid"],
                )

    return _texts(docs).mapInArrow(each, _ROW)


def _met(rows: DataFrame, kept: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` that have a partner in ``kept`` (unique by ``on``, with ``n`` rows each), with its other columns.

    Partners of over a thousandth of all rows, a thousand at most, are broadcast: no task gets all rows of a hot one.
    """
    few = kept.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in kept.columns if c not in on])
    hot, rest = few.filter(F.col("n") * 1000 > total).drop("n"), few.filter(F.col("n") * 1000 <= total).drop("n")
    same = lambda: [F.col(c) == F.col(f"_{c}") for c in on]
    names = [*rows.columns, *[c for c in kept.columns if c not in (*on, "n")]]
    cold = rows.join(F.broadcast(hot.select(*[f"_{c}" for c in on])), same(), "left_anti").join(rest.hint("merge"), same())
    return rows.join(F.broadcast(hot), same()).select(*names).union(cold.select(*names))


def _beside_hub(context: bytes, mid: int, hub: bytes, hub_mid: int) -> tuple[int, int]:
    """First and last window of ``context`` that ``hub`` has at the same distance from the gram (last < first: none)."""
    left, right = min(mid, hub_mid), min(len(context) - mid, len(hub) - hub_mid)
    if context[mid : mid + right] != hub[hub_mid : hub_mid + right]:
        x = np.frombuffer(context, np.uint8, right, mid) != np.frombuffer(hub, np.uint8, right, hub_mid)
        right = int(x.argmax())
    if context[mid - left : mid] != hub[hub_mid - left : hub_mid]:
        x = np.frombuffer(context, np.uint8, left, mid - left) != np.frombuffer(hub, np.uint8, left, hub_mid - left)
        left = int(x[::-1].argmax())
    return mid - left, mid + right - SIZE


_GROUP = ["key", "side", "half"]
_SPAN = "doc_id long, th long, a int, b int"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; rows come ordered by group (key, side, half), then doc_id, th, at, n, context."""
    out: list[tuple[int, int, int, int]] = []

    def end(group: list[tuple]) -> None:
        places: dict[bytes, list[tuple]] = {}
        for row in group:
            places.setdefault(row[-1], []).append(row[3:7])
        found = repeats(list(places)) if len(places) > 1 else [np.empty(0, np.int64)]
        for (context, rows), starts in zip(places.items(), found, strict=True):
            if len(rows) > 1:
                out.extend((doc_id, th, at, at + len(context) - SIZE) for doc_id, th, at, n in rows if n == 1)
                continue
            doc_id, th, at, n = rows[0]
            if n == 1 and len(starts):
                edge = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist(), strict=True):
                    out.append((doc_id, th, at + a, at + b))

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:3] != row[:3]:
                end(group)
                group = []
            group.append(row)
        yield _span_batch(out)
        out.clear()
    if group:
        end(group)
    yield _span_batch(out)


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "th", "a", "b"])


_PART = "key long, n long, doc_id long, th long, side int, at int, mid int, context binary"


def _wide_groups(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs shared with the hub, of the context and of the hub (``side`` null, from ``at`` to ``mid``), and the parts of
    each context whose windows the hub does not have, by their place about the gram, ``width`` places to a part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                t = batch.slice(lo, 1000).to_pydict()
                out: list[tuple] = []
                for key, doc_id, th, at, mid, n, c, hub in zip(*(t[k] for k in ("key", "doc_id", "th", "at", "mid", "n", "context", "hub")), strict=True):
                    if (doc_id, th, at) == (hub["doc_id"], hub["th"], hub["at"]):
                        continue
                    a, b = _beside_hub(c, mid, hub["context"], hub["mid"])
                    last = len(c) - SIZE
                    left = [(0, last)] if b < a else [(0, a - 1), (b + 1, last)]
                    if b >= a:
                        off = hub["at"] + hub["mid"] - mid
                        if n == 1:
                            out.append((key, 1, doc_id, th, None, at + a, at + b, None))
                        if hub["n"] == 1:
                            out.append((key, 1, hub["doc_id"], hub["th"], None, off + a, off + b, None))
                    for first, final in left:
                        while first <= final:
                            k = (mid - first) // width
                            end = min(final, mid - k * width)
                            out.append((key, n, doc_id, th, k, at + first, mid - first, c[first : end + SIZE]))
                            first = end + 1
                cols = list(zip(*out, strict=True)) if out else [[]] * 8
                types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types, strict=True)], names=["key", "n", "doc_id", "th", "side", "at", "mid", "context"])

    return each


def contexts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Contexts as they meet: by gram, ``side`` (0 before, 1 behind) and the hash of gram and 84 bytes on that side."""
    side = (SIZE - GRAM) // 2
    texts = _texts(docs).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "raw")
    held = classes.join(texts.hint("merge"), (F.col("doc_id") == F.col("d2")) & (F.col("th") == F.col("t2")))
    place, cut_at = F.col("lo") + F.col("mid"), F.col("lo") + F.col("mid") - side
    piece = lambda a, size: F.substring("raw", a + 1, size)
    # windows that start at or before cut_at hold 84 bytes before the gram, all others 84 bytes behind it; a window in
    # both parts would meet itself in the finer parts of large groups
    to, at = F.least("hi", cut_at), F.greatest("lo", cut_at + 1)
    before = F.struct(F.lit(0).alias("side"), F.xxhash64(piece(cut_at, F.lit(side + GRAM))).alias("half"), F.col("lo").alias("at"), F.col("mid").alias("mid"), piece(F.col("lo"), to - F.col("lo") + SIZE).alias("context"))
    behind = F.struct(F.lit(1).alias("side"), F.xxhash64(piece(place, F.lit(side + GRAM))).alias("half"), at.alias("at"), (place - at).alias("mid"), piece(at, F.col("hi") - at + SIZE).alias("context"))
    parts = F.array_compact(F.array(F.when(F.col("lo") <= cut_at, before), F.when(F.col("hi") > cut_at, behind)))
    return held.select("key", "n", "doc_id", "th", F.inline(parts))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th``, ``a``, ``b``: runs of windows, first to last start, that repeat; a document may have many."""
    rows = cut(anchor_rows(docs), "suffix-anchors")
    total = rows.count()
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), (F.min("ctx") == F.max("ctx")).alias("same")).filter("n > 1")
    met = cut(_met(rows, cut(keys, "suffix-keys"), ["key"], total), "suffix-met")
    whole = met.filter("same").select("doc_id", "th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    mixed = met.filter("not same").drop("same")
    classes = mixed.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi", "mid")).alias("r"))
    classes = cut(classes.select("key", "ctx", "n", "r.*"), "suffix-classes")
    again = _met(mixed, classes.filter("n > 1").select("key", "ctx", "n"), ["key", "ctx"], total).select("doc_id", "th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    held = cut(contexts(docs, classes), "suffix-contexts")
    out = whole.union(again)
    for width in (FINER, 1):
        # a context found twice is done; a group needs one found once, and a partner for it
        sizes = held.groupBy(*_GROUP).agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1").select(*[F.col(c).alias(f"_{c}") for c in _GROUP], "size")
        sized = held.join(sizes.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in _GROUP]).select(*held.columns, "size")
        few = sized.filter(F.col("size") <= MOST_CONTEXTS).select(*_GROUP, "doc_id", "th", "at", "n", "context")
        out = out.union(few.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_sorted_groups, _SPAN))
        wide = sized.filter(F.col("size") > MOST_CONTEXTS).drop("size")
        hub = wide.groupBy(*_GROUP).agg(F.max(F.struct("n", "doc_id", "th", "at", "mid", "context")).alias("hub")).select(*[F.col(c).alias(f"_{c}") for c in _GROUP], "hub")
        beside = wide.join(hub.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in _GROUP]).select("key", "doc_id", "th", "at", "mid", "n", "context", "hub")
        seen = cut(beside.mapInArrow(_wide_groups(width), _PART), "suffix-parts")
        out = out.union(seen.filter("side is null").select("doc_id", "th", F.col("at").alias("a"), F.col("mid").alias("b")).distinct())
        # what every window of a part covers: it stays the same wherever in the part a window begins
        core = F.substring("context", F.col("mid") - F.col("side") * width + 1, F.lit(SIZE - width + 1))
        held = seen.filter("side is not null").withColumn("half", F.xxhash64(core))
    twice = held.groupBy(*_GROUP).agg(F.count("*").alias("c")).filter("c > 1").select(*[F.col(c).alias(f"_{c}") for c in _GROUP])
    single = held.filter("n = 1").join(twice.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in _GROUP]).select("doc_id", "th", F.col("at").alias("a"), F.col("at").alias("b"))
    return out.union(single)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every document."""
    found = spans(docs).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    found = found.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.transform("s", lambda x: x["a"]).alias("a"), F.transform("s", lambda x: x["b"]).alias("b"))
    rows = _texts(docs).join(found.hint("merge"), (F.col("doc_id") == F.col("d2")) & (F.col("th") == F.col("t2")), "left").select("doc_id", "raw", "a", "b")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, mark = np.frombuffer(raw, np.uint8), np.zeros(len(raw) + 1, np.int32)
                if a is not None:
                    np.add.at(mark, np.array(a), 1)
                    np.add.at(mark, np.array(b) + SIZE, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edges = int(((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())) if len(gone) else 0
                out.append((doc_id, len(raw), int(gone.sum()), edges, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
