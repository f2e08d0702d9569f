"""Toxicity by a chain of classifiers.

Categories are predicted one after the other. Each has a linear (logistic) model over indicators of
byte n-grams of the lower-cased words that the category has more often than chance, and over the probabilities of the categories before it; in
training these are out-of-fold predictions, so that later models see them as they will be in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, slices, spread, table, texts
from .linear import Rows, labelled_sample, logistic, sigmoid

LENGTHS, FOLDS = (5, 6), 4
#: Labelled rows of each category and of none, at most about, and features that a model may use.
SAMPLE_ROWS, MOST_FEATURES, LEAST_ROWS, LEAST_CHI2 = 1500, 4096, 4, 10.8
TABLE_BITS = 20

#: Letters stay, in lower case; every other ASCII character becomes a blank.
_letters = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def codes(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, in order and with repeats."""
    raw = _letters[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint64)
    out, code = [], np.zeros(len(raw), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] << np.uint64(8) | raw[n - 1 :]
        if n in LENGTHS:
            out.append(code | np.uint64(n << 56))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Features:
    """The chosen n-grams; ``find`` gives those of a text by number."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = np.zeros(1 << TABLE_BITS, bool)
        self.slots[self._slot(keys)] = True
        self.order = np.argsort(keys)

    @staticmethod
    def _slot(c: np.ndarray) -> np.ndarray:
        return (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def find(self, text: str) -> np.ndarray:
        c = codes(text)
        c = np.unique(c[self.slots[self._slot(c)]])
        if not len(c) or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, c, sorter=self.order), len(self.keys) - 1)
        found = self.order[at]
        return found[self.keys[found] == c]


def _choose(listed: list[np.ndarray], y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that some category's rows have more often than chance, by chi-squared, and for which categories."""
    keys, inverse = np.unique(np.concatenate(listed), return_inverse=True)
    row = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
    n, have = len(listed), np.bincount(inverse, minlength=len(keys))
    chosen = np.zeros((len(keys), y.shape[1]), bool)
    for k in range(y.shape[1]):
        one = y[:, k].sum()
        a = np.bincount(inverse, y[row, k], len(keys))
        b, c = one - a, have - a
        d = n - one - c
        with np.errstate(divide="ignore", invalid="ignore"):
            chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
        chi2 = np.where(np.isfinite(chi2) & (a * n > have * one) & (have >= LEAST_ROWS), chi2, 0.0)
        good = np.flatnonzero(chi2 >= LEAST_CHI2)
        chosen[good[np.lexsort((keys[good], -chi2[good]))][:most], k] = True
    any_ = chosen.any(axis=1)
    return keys[any_], chosen[any_]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which flagging has the best F1 on rows that a model has not seen.

    Of cuts that are equally good, the middle of the widest gap between two rows' probabilities.
    """
    order = np.argsort(-p)
    p, hits = p[order], np.cumsum(y[order] > 0)
    if not len(p) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    gap = p - np.append(p[1:], 0.0)
    f1[gap <= 0] = -1.0  # no cut goes between equal probabilities
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(gap[best])]
    return float(p[at] - gap[at] / 2)


class Chain:
    """Per category: weights of features, weights of earlier probabilities, and a bias; and from what probability the last one is flagged."""

    def __init__(self, keys: np.ndarray, models: list[tuple[np.ndarray, np.ndarray, float]], threshold: float = 0.5):
        self.features, self.models, self.threshold = Features(keys), models, threshold

    def predict(self, found: np.ndarray) -> list[float]:
        before: list[float] = []
        for w, v, b in self.models:
            before.append(float(sigmoid(w[found].sum() + np.dot(v, before) + b)))
        return before


def fit(listed: list[np.ndarray], y: np.ndarray, most: int = MOST_FEATURES) -> Chain:
    """The chain of some rows: n-grams of each row (``codes``, once each) and 0 or 1 by category."""
    if not listed or not sum(map(len, listed)):
        share = (y.sum(axis=0) + 0.5) / (len(y) + 1)
        return Chain(np.zeros(0, np.uint64), [(np.zeros(0), np.zeros(k), float(np.log(p / (1 - p)))) for k, p in enumerate(share)])
    keys, chosen = _choose(listed, y, most)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    found = []
    for c in listed:
        at = np.minimum(np.searchsorted(sorted_keys, c), max(len(keys) - 1, 0))
        found.append(order[at[sorted_keys[at] == c]] if len(keys) else np.zeros(0, np.int64))
    n, fold = len(y), np.arange(len(y)) % FOLDS
    before, models = np.zeros((n, 0)), []
    for k in range(y.shape[1]):
        rows = Rows([f[chosen[f, k]] for f in found])
        target, unseen = y[:, k].astype(float), np.full(n, y[:, k].mean())
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(outside) and len(inside):
                w, v, b = logistic(rows.take(inside), len(keys), before[inside], target[inside])
                unseen[outside] = sigmoid(rows.take(outside).times(w) + before[outside] @ v + b)
        models.append(logistic(rows, len(keys), before, target))
        before = np.column_stack([before, unseen])
    return Chain(keys, models, best_threshold(before[:, -1], y[:, -1]))


def learn(docs: DataFrame, labels: DataFrame, categories: dict, train: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on a sample of about ``sample_rows`` labelled documents of each category and of none.

    ``categories`` maps a name to a condition on the label columns, in the order of the chain. The bound
    holds for what is broadcast and for the rows that the one fitting task reads. Of conflicting labels of
    an id the smallest row counts; rows are put in the order of their ids and of a hash of their texts, so
    that folds don't depend on how they came.
    """
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in categories.items()}
    rest = F.lit(True)
    for c in flags.values():
        rest = rest & ~c
    sample = labelled_sample(labels, {**flags, "rest_": rest}, sample_rows, train)
    sample = sample.select("doc_id", F.array(*[c.cast("int") for c in flags.values()]).alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            found = [np.unique(codes(t)).view(np.int64) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "tie", "found"])

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        listed = [x.values.to_numpy().view(np.uint64) for x in whole.column("found")]
        chain = fit(listed, np.array(whole.column("y").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chain.features.keys.tobytes()], pa.binary()),
                pa.array([[w.tobytes() for w, _, _ in chain.models]], pa.list_(pa.binary())),
                pa.array([[v.tobytes() for _, v, _ in chain.models]], pa.list_(pa.binary())),
                pa.array([[b for _, _, b in chain.models]], pa.list_(pa.float64())),
                pa.array([chain.threshold], pa.float64()),
            ],
            names=["keys", "w", "v", "b", "threshold"],
        )

    prepared = chosen.select("doc_id", "text", "y", F.xxhash64("text").alias("tie")).mapInArrow(prepare, "doc_id long, y array<int>, tie long, found array<bigint>")
    row = prepared.repartition(1).mapInArrow(train_one, "keys binary, w array<binary>, v array<binary>, b array<double>, threshold double").first()
    if row is None:
        return Chain(np.zeros(0, np.uint64), [(np.zeros(0), np.zeros(k), 0.0) for k in range(len(categories))])
    floats = lambda x: np.frombuffer(x, np.float64)
    return Chain(np.frombuffer(row[0], np.uint64), [(floats(w), floats(v), b) for w, v, b in zip(*row[1:4])], row[4])


def score(docs: DataFrame, chain: Chain, names: list[str], threshold: float | None = None) -> DataFrame:
    """(doc_id, one probability per category, score, predicted); the last category is the score.

    ``threshold`` is the probability from which documents are flagged; if none is given, it is the one
    that served best on the training rows' out-of-fold predictions. Whole texts are read. Null and empty texts have no feature and get the biases' probabilities.
    Repeated rows get equal scores; without any label every probability is 0.5 and nothing is flagged.
    """
    keys, models = chain.features.keys, chain.models
    threshold = chain.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(keys, models)
        for batch in slices(batches):
            p = np.array([own.predict(own.features.find(t)) for t in texts(batch)], float).reshape(batch.num_rows, len(names))
            flag = ((p[:, -1] >= threshold) & bool(len(keys))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pa.array(p[:, -1]), pa.array(flag)], names=["doc_id", *names, "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"`{n}` double" for n in names), "score double", "predicted int"]))


def op6_toxicity(spark, sf_dir):
    """Toxicity of every document, learned where crc32(doc_id) modulo 4 isn't 2."""
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels")
    categories = {"p_low_quality": F.col("quality") == 0, "p_toxic": F.col("toxic") == 1}
    chain = learn(docs, labels, categories, crc_remainder(labels["doc_id"], 4) != 2)
    found = score(docs, chain, list(categories))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), *categories, "score", "predicted")
