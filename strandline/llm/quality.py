"""Quality by naive-Bayes support vectors.

Features are indicators of byte n-grams, hashed into a fixed number of buckets, and of n-grams of words
that are one word again and again. They are scaled by the classes' log-count ratios and rows brought to
unit length; a linear hinge-loss model is fit to them by dual coordinate descent and its margins, taken
on rows that the fit has not seen, are calibrated. Each labelled text is also learned from as a short
window of itself, so that short texts are judged as surely as long ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, slices, spread, table, texts
from .linear import Rows, calibrate, dual_coordinate_descent, labelled_sample, sigmoid

BITS, LENGTHS, REPEATS, FOLDS = 18, (1, 2, 3), (3, 4, 6, 10), 3
#: Labelled rows of each class to learn from, at most about; the model learns from a sample of them.
SAMPLE_ROWS = 2500

_marks = np.zeros(1 << BITS, bool)


def features(text: str) -> np.ndarray:
    """The buckets of the text's n-grams, once each."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    code = np.zeros(len(raw), np.uint32)
    for n in LENGTHS:
        code = code[: len(raw) - n + 1] << np.uint32(8) | raw[n - 1 :] if len(raw) >= n else code[:0]
        _marks[(code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True
    words, run, longest = text.split(), 1, 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        if run > longest:
            longest = run
    _marks[[n for n in REPEATS if longest >= n]] = True
    found = np.flatnonzero(_marks)
    _marks[found] = False
    return found


def window(text: str) -> str:
    """A part of the text of 20 to 400 characters, chosen by the text itself."""
    at = zlib.crc32(text.encode())
    size = 20 + at % 381
    begin = at // 381 % max(len(text) - size, 1)
    return text[begin : begin + size]


def _ratios(rows: Rows, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of each feature's share among ones and among zeros."""
    one = rows.back((y > 0).astype(float), 1 << BITS) + alpha
    zero = rows.back((y <= 0).astype(float), 1 << BITS) + alpha
    return np.log(one / one.sum()) - np.log(zero / zero.sum())


class Model:
    """Weights by bucket (``ratio`` and ``weight`` multiplied), squared ratios, bias and calibration."""

    def __init__(self, product: np.ndarray, square: np.ndarray, bias: float, a: float, b: float):
        self.product, self.square, self.bias, self.a, self.b = product, square, bias, a, b

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt(self.square[found].sum())
        return float(self.product[found].sum() / length if length else 0.0) + self.bias

    def score(self, text: str) -> float:
        return float(sigmoid(self.a * self.margin(features(text)) + self.b))


def _fit(rows: Rows, y: np.ndarray, passes: int, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    ratio = _ratios(rows, y)
    ones = max(y.sum(), 1)
    each = np.where(y > 0, cost * len(y) / (2 * ones), cost * len(y) / (2 * max(len(y) - ones, 1)))
    w, bias = dual_coordinate_descent(rows, ratio, y, each, passes)
    return (ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32), bias


def fit(listed: list[np.ndarray], y: np.ndarray, group: np.ndarray, passes: int = 12, cost: float = 1.0) -> Model:
    """The model of some rows; those of one group (a text and its window) are held out together. With one class alone every score is that class's smoothed share."""
    none = np.zeros(1 << BITS, np.float32)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    rows, fold = Rows(listed), np.unique(group, return_inverse=True)[1] % FOLDS
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(np.unique(y[inside])) < 2 or not len(outside):
            continue
        part = Model(*_fit(rows.take(inside), y[inside], passes, cost), 1.0, 0.0)
        margin[outside] = [part.margin(listed[i]) for i in outside]
    return Model(*_fit(rows, y, passes, cost), *calibrate(margin, y))


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of about ``sample_rows`` labelled documents of each class.

    ``sample_rows`` bounds what is broadcast and what the one fitting task reads. Of conflicting labels of
    an id the smallest counts; rows without a label are left out.
    """
    y = F.col(label_col)
    sample = labelled_sample(labels.select("doc_id", label_col), {"one": y == 1, "zero": y == 0}, sample_rows, train).select("doc_id", y.cast("int").alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for form in (str, window):
                found = [features(form(t)) for t in texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "found"])

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        # Rows in an order of their own, so that the model doesn't depend on how they came.
        whole = pa.Table.from_batches(got)
        listed = [np.array(x, np.int64) for x in whole.column("found").to_pylist()]
        ids, y = whole.column("doc_id").to_numpy(), whole.column("y").to_numpy()
        order = sorted(range(len(y)), key=lambda i: (ids[i], len(listed[i]), listed[i].tobytes()))
        model = fit([listed[i] for i in order], y[order], ids[order])
        rest = [model.bias, model.a, model.b]
        yield pa.RecordBatch.from_arrays([pa.array([model.product.tobytes()], pa.binary()), pa.array([model.square.tobytes()], pa.binary()), pa.array([rest])], names=["product", "square", "rest"])

    prepared = chosen.select("doc_id", "text", "y").mapInArrow(prepare, "doc_id long, y int, found array<int>")
    row = prepared.repartition(1).mapInArrow(train_one, "product binary, square binary, rest array<double>").first()
    if row is None:
        none = np.zeros(1 << BITS, np.float32)
        return Model(none, none, 0.0, 1.0, 0.0)
    return Model(np.frombuffer(row[0], np.float32), np.frombuffer(row[1], np.float32), *row[2])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, from the whole text.

    Null and empty texts have no feature and get the score of the bias alone. Repeated rows get equal
    scores; an empty table gives an empty result; without any label every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = np.array([model.score(t) for t in texts(batch)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op1_quality(spark, sf_dir):
    """Quality of every document, learned where crc32(doc_id) modulo 4 isn't 2."""
    docs, labels = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels")
    model = learn(docs, labels, crc_remainder(labels["doc_id"], 4) != 2)
    return score(docs, model).select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
