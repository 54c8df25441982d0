"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two bases modulo 2**31 - 1, the sums of code * base**position up to every position. With
them any two spans are compared in constant time, the longest common extension of two positions is a binary search,
and the arrays of a text that is spliced from two others follow from theirs without reading a character.

A fingerprint takes the hash of every span of 16 code points (a shorter text is one span) and keeps the least in each
of 128 bins: 128 x 16 bits, as hex. Likeness of two fingerprints is the share of text in common: with J the share of
bins that agree among those that either fills (the Jaccard similarity of the span sets, estimated), 2 J / (1 + J).

``next`` is the next document in descending doc_id, and the first after the last. It is found by dealing documents to
ranges of doc_id; each range also gets a copy of the document that opens the range below it. No range is global.

Defined cases: null text is the empty text; two empty fingerprints are alike by 1, an empty and another by 0; rows
with equal doc_id follow each other by text; a null doc_id comes after all others; a table of one document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.llm.shared import text_of

U = np.uint64
M = U(2**31 - 1)
BASES = (1_000_003, 1_299_709)
SPAN, BINS, EMPTY = 16, 128, 0xFFFF
ROWS_PER_RANGE, MOST_RANGES, SEGMENTS = 500, 65_536, 64

OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, lce_edited long, lce_next long"
)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime 2**31 - 1, for x < 2**63."""
    x = (x & M) + (x >> U(31))
    x = (x & M) + (x >> U(31))
    x[x >= M] -= M
    return x


class _Powers:
    """base**k and base**-k modulo M, as long as the longest text so far."""

    def __init__(self, base: int):
        self.own = [np.ones(1, U), np.ones(1, U)]
        self.step = [base, pow(base, -1, int(M))]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.own[0]) < n:
            for k in (0, 1):
                size = len(self.own[k])
                self.own[k] = np.concatenate([self.own[k], _mod(self.own[k] * U(pow(self.step[k], size, int(M))))])
        return self.own[0], self.own[1]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix sums of a text's polynomial hashes: ``sums[b][i]`` covers the first i code points."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums, self.n = sums, len(sums[0]) - 1

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U) + U(1)
        sums = []
        for p in _POWERS:
            total = np.zeros(len(codes) + 1, U)
            np.cumsum(_mod(codes * p.upto(len(codes))[0][: len(codes)]), out=total[1:])
            sums.append(_mod(total))
        return cls(sums)

    def spliced(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """Of this text's first ``keep`` code points followed by the other's first ``take``."""
        sums = []
        for p, own, more in zip(_POWERS, self.sums, other.sums, strict=True):
            shift = p.upto(keep + 1)[0][keep]
            sums.append(np.concatenate([own[: keep + 1], _mod(own[keep] + _mod(more[1 : take + 1] * shift))]))
        return PrefixHash(sums)

    def spans(self, size: int) -> np.ndarray:
        """Hashes (62 bits) of all spans of ``size`` code points, by start."""
        n = self.n - size + 1
        parts = []
        for p, own in zip(_POWERS, self.sums, strict=True):
            parts.append(_mod(_mod(own[size:] + (M - own[:n])) * p.upto(n)[1][:n]))
        return (parts[0] << U(31)) | parts[1]

    def same(self, i: int, other: PrefixHash, j: int, size: int) -> bool:
        """Whether the spans of ``size`` at i here and at j there are equal."""
        for p, a, b in zip(_POWERS, self.sums, other.sums, strict=True):
            up = p.upto(max(i, j) + 1)[0]
            x = (int(a[i + size]) - int(a[i])) * int(up[j])
            y = (int(b[j + size]) - int(b[j])) * int(up[i])
            if (x - y) % int(M):
                return False
        return True

    def lce(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(i, other, j, mid) else (lo, mid - 1)
        return lo

    def fingerprint(self) -> np.ndarray:
        out = np.full(BINS, EMPTY, np.uint16)
        if not self.n:
            return out
        v = self.spans(min(SPAN, self.n))
        v = v * U(0x9E3779B97F4A7C15)
        v ^= v >> U(32)
        v *= U(0xD6E8FEB86659FD93)
        shift = U(64 - BINS.bit_length() + 1)
        some = v
        if len(v) > 24 * BINS:  # the least of each bin is very likely among the least 16 per bin
            rest = v & ((U(1) << shift) - U(1))
            some = v[rest < U((1 << int(shift)) // len(v) * 16 * BINS)]
        some = np.sort(some)
        at = (some >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        if len(first) < BINS and len(some) < len(v):
            some = np.sort(v)
            at = (some >> shift).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        low = (some[first] * U(0xFF51AFD7ED558CCD)) >> U(48)
        out[at[first]] = np.minimum(low, EMPTY - 1).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    if not n:
        return 1.0
    j = int(((a == b) & filled).sum()) / n
    return 2 * j / (1 + j)


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def _ranges(docs: DataFrame) -> Column:
    """A range number that ascends with doc_id and deals out documents about evenly, whatever the ids' spacing."""
    n = docs.count()
    if not n:
        return F.lit(0).cast("long")
    want = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    segments = min(SEGMENTS, want)
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(k / segments) for k in range(segments + 1)]), 10_000)).first()[0]
    if cuts is None:
        return F.lit(0).cast("long")
    cuts[0] = docs.select(F.min("doc_id")).first()[0]
    cuts[-1] = docs.select(F.max("doc_id")).first()[0] + 1
    per = max(1, want // segments)
    inner = F.array(*[F.lit(c).cast("long") for c in cuts[1:-1]]) if segments > 1 else F.array().cast("array<bigint>")
    at = F.size(F.filter(inner, lambda c: c <= F.col("doc_id")))
    lo = F.get(F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]), at)
    hi = F.get(F.array(*[F.lit(c).cast("long") for c in cuts[1:]]), at)
    inside = F.floor((F.col("doc_id") - lo) / F.greatest(hi - lo, F.lit(1)) * per)
    return (at.cast("long") * per + F.least(F.greatest(inside, F.lit(0)), F.lit(per - 1))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """``range``, ``guest``, ``doc_id``, ``text``, sorted: within a range a row's next document is the row below it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    number = F.coalesce(_ranges(rows.select("doc_id")), F.lit(0).cast("long"))
    # one row per range (at most MOST_RANGES): which document opens it, and which range that document also closes
    tops = rows.select("doc_id", number.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("range")
    goes = tops.select("top", F.coalesce(F.lead("range").over(order), F.first("range").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                       .alias("also"))
    dealt = rows.withColumn("range", number).join(F.broadcast(goes), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("also").alias("range"), F.lit(1).alias("guest"))
    spread = dealt.select("doc_id", "text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("g"))
    out = spread.select(F.col("g.range").alias("range"), F.col("g.guest").alias("guest"), "doc_id", "text").repartition("range")
    return out.sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the next document's start)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for number, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = PrefixHash.of(text)
                now = (number, guest, doc_id, text, own, own.fingerprint())
                if before is not None and before[0] == number and not before[1]:
                    rows.append(pair(before, now))
                before = now
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    fields = [f.split() for f in OUT.split(", ")]
    names = [n for n, _ in fields]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t] for _, t in fields]

    def pair(a: tuple, b: tuple) -> tuple:
        _, _, doc_id, text, own, mark = a
        n = own.n
        k = min(n // 3, b[4].n)
        keep = n - n // 3
        edited = text[:keep] + b[3][:k]
        other = own.spliced(keep, b[4], k)
        theirs = other.fingerprint()
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return (doc_id, n, sha, written(mark), written(theirs), likeness(mark, theirs), likeness(mark, b[5]), own.lce(0, other, 0), own.lce(0, b[4], 0))

    return with_next(docs).mapInArrow(each, OUT)
