"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics. Per class the
mean and covariance come from additive moments gathered on Spark (count, sum and
sum of products), the covariance is shrunk towards the pooled one and towards its
own diagonal, and its Cholesky factor is kept. The score is the posterior from
the difference of the two Mahalanobis log densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnum
from skyloom.llm.common import cut, documents, fold, held_out, slim, table

FEATURES = (
    "log_words", "mean_word", "spread_word", "upper", "digit", "stop_mark", "shout", "symbol", "pipe",
    "lines", "unique_words", "repeated_lines", "long_words", "capital_words", "odd_bytes",
)
SHRINK_POOLED, SHRINK_DIAGONAL, THRESHOLD = 0.10, 0.05, 0.3
SCHEMA = "doc_id long, features array<double>"


#: Byte classes: other, upper case, digits, stops, exclamation marks, pipes, symbols, control bytes.
_UPPER, _DIGIT, _STOP, _SHOUT, _PIPE, _SYMBOL, _ODD, _CLASSES = 1, 2, 3, 4, 5, 6, 7, 8
_CLASS_OF = np.zeros(256, np.int32)
for _k, _chars in (
    (_UPPER, bytes(range(65, 91))), (_DIGIT, b"0123456789"), (_STOP, b".,;:?'\"-()"), (_SHOUT, b"!"), (_PIPE, b"|"),
    (_SYMBOL, b"#$%&*+/<=>@[\\]^_`{}~"), (_ODD, bytes(range(0, 9)) + bytes(range(14, 32)) + b"\x7f"),
):
    _CLASS_OF[list(_chars)] = _k


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys for each of n owners."""
    if len(keys) == 0:
        return np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
    return np.bincount(o[first], minlength=n).astype(float)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The feature matrix, a row per document; documents without words get neutral zeros."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1).astype(float)

    kinds = np.repeat(np.arange(n, dtype=np.int32) * _CLASSES, np.diff(offsets))
    kinds += _CLASS_OF[raw]
    counts = np.bincount(kinds, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    starts, ends = textnum.runs(~textnum.SPACE[raw], offsets)
    at = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(n), np.diff(at))
    # Letters, not bytes: continuation bytes of UTF-8 sequences don't count.
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    length = (chars[ends] - chars[starts]).astype(float)
    words = np.diff(at).astype(float)
    w1 = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / w1
    var = np.maximum(np.bincount(owner, length**2, n) / w1 - mean**2, 0)
    hashes = textnum.run_hashes(raw, starts, ends)
    line_start, line_end = textnum.runs(raw != 10, offsets)
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    distinct_lines = _distinct(textnum.run_hashes(raw, line_start, line_end), line_owner, n)
    capital = np.bincount(owner, (_CLASS_OF[raw[starts]] == _UPPER).astype(float), n) / w1 if len(starts) else np.zeros(n)
    unique = _distinct(hashes, owner, n) / w1
    root = lambda kind: np.sqrt(counts[:, kind] / sizes)
    rate = lambda kind: np.log1p(counts[:, kind] / w1)
    out = np.stack([
        np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(var)), root(_UPPER), root(_DIGIT),
        rate(_STOP), rate(_SHOUT), rate(_SYMBOL),
        rate(_PIPE), np.log1p(lines / w1 * 100), unique, 1 - distinct_lines / np.maximum(lines, 1),
        np.sqrt(np.bincount(owner, (length > 20).astype(float), n) / w1), capital, root(_ODD),
    ], 1)
    out[words == 0] = 0
    return out


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textnum.slices(batches, "text"):
        x = statistics(*textnum.string_buffer(batch.column(1)))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), values], ["doc_id", "features"])


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every whole text; null and empty texts have zeros."""
    return slim(docs, "doc_id", "text").mapInArrow(feature_batches, SCHEMA)


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse of the Cholesky factor and half log determinant."""

    scale: np.ndarray
    parts: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), 0.5)
        logs = []
        for prior, mean, inverse, half in self.parts:
            z = ((x * self.scale) - mean) @ inverse.T
            logs.append(prior - half - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(rows: DataFrame) -> DataFrame:
    """Count, sum and sum of products of the features by label: a row per label and task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(FEATURES)
        total = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, p)
            y = np.asarray(batch.column(0))
            for k in total:
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["label", "total"])

    return rows.mapInArrow(gather, "label int, total array<double>")


def fit(labelled: DataFrame, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """Fits on rows (label int, features); the driver gets one row of sums for each label.

    Two classes with fewer than two rows each can't be told apart: every score is then 0.5.
    """
    p = len(FEATURES)
    sums = moments(labelled).select("label", F.posexplode("total").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    total = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
    for r in sums.collect():  # 2 x (1 + p + p*p) rows, whatever the input
        total[r.label][r.k] = r.v
    n = {k: v[0] for k, v in total.items()}
    if min(n.values()) < 2:
        return Discriminant(np.ones(p), [])
    mean = {k: v[1 : 1 + p] / v[0] for k, v in total.items()}
    scatter = {k: v[1 + p :].reshape(p, p) - n[k] * np.outer(mean[k], mean[k]) for k, v in total.items()}
    pool = (scatter[0] + scatter[1]) / (n[0] + n[1])
    scale = 1 / np.sqrt(np.maximum(np.diag(pool), 1e-6))
    pool = pool * np.outer(scale, scale)
    parts = []
    for k in (0, 1):
        c = scatter[k] / n[k] * np.outer(scale, scale)
        c = (1 - pooled) * c + pooled * pool
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(p)
        factor = np.linalg.cholesky(c)
        parts.append((float(np.log(n[k] / (n[0] + n[1]))), mean[k] * scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Discriminant(scale, parts)


def score(features: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (posterior of label 1) and predicted for each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = features.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def labelled_rows(features: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Training rows: labelled documents outside the held-out fold. Null labels don't count."""
    marks = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("doc_id", 5) != 0))
    return features.join(marks, "doc_id").select("label", "features")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document for quality.

    Null and empty texts are scored like any other, by their neutral statistics;
    repeated rows get equal scores; a null doc_id is scored, counts as held out and is never trained on;
    empty tables give empty results; extra columns are not read.
    """
    features = cut(featurise(docs), "quality-features")
    return score(features, fit(labelled_rows(features, slim(labels, "doc_id", "quality"), "quality")))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
