"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed over the whole text, vectorised over the bytes of many documents. Trees are grown on the
driver from a bounded sample of labelled rows (``MOST_ROWS``), flattened into arrays, and every document is scored by
walking all trees at once.

Defined cases: null text is the empty text and gets the score of its (zero) statistics; with no labelled rows, or one
label only, every score is the label's smoothed mean, 0.5 without rows; repeated rows are scored each; other columns
are ignored. Language, source, id and labels are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.hashing import IS_SPACE, joined, shingle_sets, slices, words
from trestle.llm.samples import held_out, training_texts

#: Labelled rows used for training, at most; rounds; leaves; histogram bins.
MOST_ROWS, ROUNDS, LEAVES, BINS, RATE = 20_000, 80, 12, 64, 0.15

_b = np.arange(256)
_in = lambda s: np.isin(_b, list(s.encode()))
#: Byte classes whose share of the text is a statistic.
CLASSES = {
    "lower": (_b >= 97) & (_b <= 122),
    "upper": (_b >= 65) & (_b <= 90),
    "digit": (_b >= 48) & (_b <= 57),
    "space": IS_SPACE,
    "newline": _b == 10,
    "stop": _in(".!?"),
    "comma": _in(",;:"),
    "symbol": _in("#*$%&|<>"),
    "bracket": _in("()[]{}"),
    "quote": _in("\"'`"),
    "other_punctuation": _in("-_/\\@+=~^"),
    "control": (_b < 9) | ((_b > 13) & (_b < 32)) | (_b == 127),
    "high": _b >= 128,
}
FEATURES = [*CLASSES, "log_bytes", "log_words", "word_length", "distinct_words", "distinct_runs", "words_per_line", "entropy", "digit_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """(len(texts), len(FEATURES)) float64."""
    data, ends = joined(texts)
    m, size = len(texts), np.diff(ends)
    some = np.maximum(size, 1)
    owner = np.repeat(np.arange(m) * 256, size)
    hist = np.bincount(owner + data, minlength=m * 256).reshape(m, 256) if m else np.zeros((0, 256))
    share = hist / some[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    h, of = words(texts)
    n_words = np.bincount(of, minlength=m) if len(of) else np.zeros(m, np.int64)
    one = np.diff(shingle_sets(texts, 1)[1])
    run = np.diff(shingle_sets(texts, 5)[1])
    some_words = np.maximum(n_words, 1)
    spaces = hist[:, IS_SPACE].sum(1)
    cols = [share[:, c].sum(1) for c in CLASSES.values()]
    cols += [np.log1p(size), np.log1p(n_words), (size - spaces) / some_words, one / some_words, run / np.maximum(n_words - 4, 1)]
    cols += [n_words / (hist[:, 10] + 1), entropy, hist[:, CLASSES["digit"]].sum(1) / some_words]
    return np.column_stack(cols)


class Trees:
    """Flat arrays over all nodes of all trees; a leaf points to itself."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, [], 0
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        k = len(self.value)
        for a, x in ((self.feature, 0), (self.cut, 0.0), (self.left, k), (self.right, k), (self.value, 0.0)):
            a.append(x)
        return k

    def frozen(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(a, np.int32) for a in (self.feature, self.left, self.right, self.roots))
        self.cut, self.value = np.array(self.cut), np.array(self.value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost on the logistic loss; each tree grows leaf by leaf, by the best gain over binned histograms."""
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    out = Trees(float(np.log(mean / (1 - mean))))
    if len(y) < 20 or y.min() == y.max():
        return out.frozen()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    flat = code + np.arange(x.shape[1]) * BINS
    width, f = x.shape[1] * BINS, np.full(len(y), out.base)
    least, ridge = max(5, len(y) // 500), 1.0
    last = np.array([len(e) for e in edges])
    open_cut = np.arange(BINS)[None, :] < last[:, None]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        cells, n = flat[rows].ravel(), x.shape[1]
        sums = [np.bincount(cells, np.repeat(v[rows], n), width).reshape(n, BINS).cumsum(1) for v in (g, h, np.ones(len(y)))]
        gl, hl, cl = sums
        g0, h0, c0 = (s[:, -1:] for s in sums)
        gain = gl**2 / (hl + ridge) + (g0 - gl) ** 2 / (h0 - hl + ridge) - g0**2 / (h0 + ridge)
        gain = np.where(open_cut & (cl >= least) & (c0 - cl >= least), gain, -1)
        k = int(gain.argmax())
        return float(gain.flat[k]), *divmod(k, BINS)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        root = out.node()
        out.roots.append(root)
        leaves = {root: (np.arange(len(y)), 0)}
        found = {root: best(leaves[root][0], g, h)}
        while len(leaves) < LEAVES:
            k = max(found, key=lambda n: found[n][0])
            gain, column, bin_ = found[k]
            if gain <= 1e-6:
                break
            rows, depth = leaves.pop(k)
            del found[k]
            goes = code[rows, column] <= bin_
            out.feature[k], out.cut[k] = column, float(edges[column][bin_])
            out.left[k], out.right[k] = out.node(), out.node()
            out.depth = max(out.depth, depth + 1)
            for child, part in ((out.left[k], rows[goes]), (out.right[k], rows[~goes])):
                leaves[child] = (part, depth + 1)
                found[child] = best(part, g, h)
        for k, (rows, _) in leaves.items():
            out.value[k] = float(RATE * g[rows].sum() / (h[rows].sum() + ridge))
            f[rows] += out.value[k]
    return out.frozen()


def _measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                x = statistics(batch.column(1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["doc_id", "x", *extra])

    schema = ", ".join(["doc_id long", "x array<double>", *[f"{c} int" for c in extra]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).mapInArrow(measure, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Trees:
    rows = _measured(training_texts(docs, labels, "quality", most), ["y"]).orderBy("doc_id").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(np.float64) if len(rows) else np.zeros(0))


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (higher: label 1 is likelier), ``predicted`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                s = model.value.score(statistics(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
