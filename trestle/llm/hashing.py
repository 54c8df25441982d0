"""Vectorised 64-bit hashes of words and word shingles over the bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 0xD1342543DE82EF95

_byte = np.arange(256)
IS_SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
_VALUES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, U)
    step = base % 2**64
    while len(out) < n:
        out = np.concatenate([out, out * U(step)])
        step = step * step % 2**64
    return out


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    return _powers(1 << max(16, int(n).bit_length()), base)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end (nulls are empty), and len + 1 offsets."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(texts) else np.empty(0, np.uint8)
    return data, (ends - ends[0]) if len(texts) else np.zeros(1, np.int64)


def words(texts: pa.Array, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, in order, and the number of the text each belongs to.

    With ``beginnings``, the hashes of the first so many bytes of all longer words follow, as if they were words.
    """
    data, ends = joined(texts)
    n = len(data)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    firsts = ends[:-1][ends[:-1] < n]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[firsts[firsts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, U)
    np.cumsum(_VALUES[LOWER[data]] * powers(n), out=total[1:])
    inverse = powers(n, pow(_BASE, -1, 2**64))
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(_STEP))
    text = np.searchsorted(ends, start, "right") - 1
    if not beginnings:
        return hashes, text
    parts, owners = [hashes], [text]
    for size in beginnings:
        long = start[end - start > size]
        parts.append(mix((total[long + size] - total[long]) * inverse[long] + U(size * _BASE % 2**64)))
        owners.append(text[end - start > size])
    return np.concatenate(parts), np.concatenate(owners)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, ascending, end to end, and len + 1 offsets.

    A text of fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    h, text = words(texts)
    m, n = len(texts), len(h)
    counts = np.bincount(text, minlength=m) if n else np.zeros(m, np.int64)
    first = np.cumsum(counts) - counts
    run = h.copy()
    for j in range(1, k):
        run[: n - j] = run[: n - j] * U(_STEP) + h[j:]
    keep = np.zeros(n, bool)
    if n >= k:
        keep[: n - k + 1] = text[: n - k + 1] == text[k - 1 :]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for t in short:
        a, c = first[t], int(counts[t])
        x = c
        for v in h[a : a + c].tolist():
            x = (x * _STEP + v) % 2**64
        run[a] = x
        keep[a] = True
    out, of = mix(run[keep]), text[keep]
    sizes = np.bincount(of, minlength=m) if len(of) else np.zeros(m, np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b].sort()
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
        out, of = out[new], of[new]
        sizes = np.bincount(of, minlength=m)
    return out, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2_000_000):
    """Pieces of a batch of bounded text size; one row at least."""
    lo, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for hi, x in enumerate(lengths):
        if hi > lo and size + x > most_bytes:
            yield batch.slice(lo, hi - lo)
            lo, size = hi, 0
        size += x
    if batch.num_rows > lo:
        yield batch.slice(lo)
