"""Toxicity by a classifier chain over linear models.

The chain predicts its categories one after the other; each later model also sees the earlier categories'
probabilities. In training these are out-of-fold predictions, so that a later model learns from probabilities as
they are on unseen documents. Inputs are the presence of hashed words; a chi-squared test over the training sample
keeps the words that tell, so that long clean texts don't add up noise.

``labels`` has one label, ``toxic``. The finer categories are learned too: toxic rows of the sample are grouped by
the telling words that they share (k-means from far-apart rows), and a group is a category. A toxic row without such a
word carries none. The chain ends in ``toxic`` itself. No list of words is an input.

Defined cases: null text is the empty text and has no words; with no labelled rows, or none of either kind, a
category's probability is its smoothed mean; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.hashing import slices, words
from trestle.llm.samples import held_out, training_texts

#: Labelled rows used for training, at most; hash bits; words kept; folds.
MOST_ROWS, BITS, MOST_WORDS, FOLDS = 15_000, 20, 240, 5
BEGINNINGS = (4, 5, 6, 7, 8)
KINDS = ["kind_1", "kind_2"]
CHAIN = [*KINDS, "toxic"]


def _bare(texts: pa.Array) -> pa.Array:
    """Punctuation to spaces, so that a word is the same with a comma."""
    return pc.replace_substring_regex(texts.fill_null(""), r"[!-/:-@\[-`{-~]+", " ")


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text's number and the hash of a word, or of the beginning of one, for each in the texts."""
    h, of = words(_bare(texts), BEGINNINGS)
    return of, (h >> np.uint64(64 - BITS)).astype(np.int64)


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct occurrences, sorted by text."""
    of, word = occurrences(texts)
    pairs = np.unique((of.astype(np.uint64) << np.uint64(BITS)) | word.astype(np.uint64))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _grouped(x: np.ndarray, n: int, rounds: int = 20) -> np.ndarray:
    """A group from 0 to n - 1 for each row by the cosine of its words, the largest first; -1 for rows without any.
    Starts from the row nearest to the mean and those farthest from the starts before: the same for the same rows."""
    out = np.full(len(x), -1)
    some = np.flatnonzero(x.any(1))
    if not len(some):
        return out
    v = x[some] / np.linalg.norm(x[some], axis=1, keepdims=True)
    starts = [int((v @ v.mean(0)).argmax())]
    while len(starts) < n:
        starts.append(int((v @ v[starts].T).max(1).argmin()))
    middle = v[starts]
    for _ in range(rounds):
        own = (v @ middle.T).argmax(1)
        sums = np.array([v[own == k].sum(0) for k in range(n)])
        middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    order = np.argsort(-np.bincount(own, minlength=n), kind="stable")
    out[some] = np.argsort(order)[own]
    return out


def _fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Logistic regression with an L2 penalty by damped Newton steps; the last weight is the intercept."""
    n, d = x.shape
    a = np.column_stack([x, np.ones(n)])
    w = np.zeros(d + 1)
    mean = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(mean / (1 - mean))
    if y.min(initial=1) == y.max(initial=0) or n < 20:
        return w
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        m = a @ v
        return float((np.logaddexp(0, m) - y * m).sum() + (penalty * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        while (after := loss(w + step)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        if after > now:
            break
        w, before, now = w + step, now, after
        if before - now < 1e-4:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    def __init__(self, slots: np.ndarray, weights: list[np.ndarray]):
        self.slots, self.weights = slots, weights  # slots: hashed word -> column, or -1

    def matrix(self, texts: pa.Array) -> np.ndarray:
        return _matrix(self.slots, *occurrences(texts), len(texts))

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.column_stack([x, _probability(x, w)])
        return x[:, -len(self.weights) :]


def _matrix(slots: np.ndarray, of: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, int(slots.max(initial=-1)) + 1))
    col = slots[word]
    x[of[col >= 0], col[col >= 0]] = 1
    return x


def fit(of: np.ndarray, word: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Chain:
    """``of``, ``word``: distinct (row, hashed word); ``folds``: a number from 0 to FOLDS - 1 per row."""
    n, size = len(y), 1 << BITS
    slots = np.full(size, -1, np.int32)
    if n and 0 < y.sum() < n:
        # chi-squared of presence against the label; only words in five rows or more
        with_ = np.bincount(word, minlength=size).astype(float)
        hit = np.bincount(word, y[of], minlength=size)
        rate = y.mean()
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (hit - with_ * rate) ** 2 * n / (with_ * rate * (1 - rate) * (n - with_ + 1e-9))
        chi[(with_ < 5) | ~np.isfinite(chi)] = 0
        order = np.lexsort((np.arange(size), -chi))[:MOST_WORDS]
        order = order[chi[order] > 15]
        slots[order] = np.arange(len(order), dtype=np.int32)
    x = _matrix(slots, of, word, n)
    weights = []
    kind = np.full(n, -1)
    kind[y > 0] = _grouped(x[y > 0], len(KINDS))
    for k, name in enumerate(CHAIN):
        goal = y if name == "toxic" else (kind == k).astype(np.float64)
        weights.append(_fit_linear(x, goal))
        seen = np.zeros(n)
        for fold in range(FOLDS):
            out = folds == fold
            seen[out] = _probability(x[out], _fit_linear(x[~out], goal[~out]))
        x = np.column_stack([x, seen])
    return Chain(slots, weights)


def _presence_lists(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                of, word = presence(batch.column(1))
                cuts = np.searchsorted(of, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "words", "y"])

    return docs.select("doc_id", "text", "y").mapInArrow(each, "doc_id long, words array<int>, y int")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Chain:
    rows = _presence_lists(training_texts(docs, labels, "toxic", most)).orderBy("doc_id").toArrow()
    n, lists = len(rows), rows.column("words").chunks
    of = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(rows.column("words")).to_numpy())
    word = np.concatenate([np.zeros(0, np.int32), *[x.flatten().to_numpy() for x in lists]])
    y = rows.column("y").to_numpy().astype(np.float64)
    del rows, lists
    return fit(of, word, y, np.arange(n) % FOLDS)


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, a probability per category, ``score`` (of ``toxic``) and ``toxic`` (score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                p = model.value.predict(model.value.matrix(batch.column(1)))
                cols = [pa.array(p[:, k]) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *cols, pa.array(p[:, -1]), pa.array((p[:, -1] >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", *[f"p_{c}" for c in KINDS], "score", "toxic"],
                )

    schema = ", ".join(["doc_id long", "held_out boolean", *[f"p_{c} double" for c in KINDS], "score double", "toxic int"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, schema)
