"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes FEATURES transformed statistics (lengths, shares of character kinds, repetition, entropy). Means and
second moments of both classes are sums over all labelled training rows, made in the tasks and added by Spark; the driver
sees one matrix per class. Class covariances are shrunk, by SHRINK towards the pooled one and by RIDGE towards the
diagonal, and factored once (Cholesky). A text's score is the logistic of the difference of the classes' Gaussian
log-densities (Mahalanobis distances by the cached factors) and log-priors, tempered by a curve fitted on training rows.

Texts are read once: statistics are written out, labels join those and not texts.

Null and empty texts have statistics of their own (all counts zero). Without labels of both classes every score is the
share of good rows, or 0.5 without any. Labels of one id are joined by their maximum; null labels are ignored. Equal texts
score equally. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C
from reviewlake.llm.toxicity import held_out, labelled, logistic

SHRINK, RIDGE = 0.1, 0.02
CUT = 0.5
FEATURES = (
    "words", "bytes", "word_bytes", "upper", "digits", "stops", "symbols", "other_bytes", "lines", "line_bytes", "distinct_words",
    "same_as_before", "distinct_pairs", "distinct_fives", "symbol_ends", "entropy", "top_word", "short_words", "longest_word", "distinct_lines",
)


def _kinds(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[r] = True
    return out


_UPPER, _LOWER_CASE, _DIGIT, _STOP = _kinds(slice(65, 91)), _kinds(slice(97, 123)), _kinds(slice(48, 58)), _kinds(list(b".,;:?'-"))
_SYMBOL = _kinds(slice(33, 48), slice(58, 65), slice(91, 97), slice(123, 127)) & ~_STOP
_OTHER = _kinds(slice(128, 256))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, doc = C.word_spans(data, offsets)
    words = np.bincount(doc, minlength=n).astype(float)
    marks = C.Rolling(data)
    name = marks.names(starts, ends)
    length = ends - starts

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(table[data]))[offsets]).astype(float)

    def odds(part: np.ndarray, whole: np.ndarray, least: float = 0.5) -> np.ndarray:
        return np.log((part + least) / (np.maximum(whole - part, 0) + least))

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Distinct keys of each document."""
        mixed, at = np.unique(C.splitmix(keys + C.splitmix(of.astype(C.U64) + C.U64(1))), return_index=True)
        return np.bincount(of[at], minlength=n).astype(float)

    def grams(k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(name) < k:
            return np.zeros(0, C.U64), np.zeros(0, np.int64)
        keep = doc[k - 1 :] == doc[: len(doc) - k + 1]
        mixed = np.zeros(len(name) - k + 1, C.U64)
        for j in range(k):
            mixed = C.splitmix(mixed + name[j : len(name) - k + 1 + j])
        return mixed[keep], doc[k - 1 :][keep]

    pairs, pair_doc = grams(2)
    fives, five_doc = grams(5)
    upper, lower = count(_UPPER), count(_LOWER_CASE)
    same = np.zeros(len(doc), bool)
    same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    line_starts, line_ends, line_doc = C.runs(data != 10, offsets)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    key, key_at, key_n = np.unique(C.splitmix(name + C.splitmix(doc.astype(C.U64) + C.U64(1))), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, doc[key_at], key_n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    byte = np.unique(np.repeat(np.arange(n) * 256, np.diff(offsets)) + data, return_counts=True)
    share = byte[1] / size[byte[0] // 256]
    entropy = np.bincount(byte[0] // 256, -share * np.log2(share), n)
    columns = [
        np.log1p(words), np.log1p(size), np.log1p(np.bincount(doc, length, n) / np.maximum(words, 1)), odds(upper, upper + lower), odds(count(_DIGIT), size),
        odds(count(_STOP), size), odds(count(_SYMBOL), size), odds(count(_OTHER), size), odds(lines, words + 1), np.log1p(size / np.maximum(lines, 1)),
        odds(distinct(name, doc), words), odds(np.bincount(doc, same, n), words), odds(distinct(pairs, pair_doc), np.bincount(pair_doc, minlength=n)),
        odds(distinct(fives, five_doc), np.bincount(five_doc, minlength=n)), odds(np.bincount(doc, _SYMBOL[data[ends - 1]] if len(ends) else None, n), words), entropy,
        odds(top, words), odds(np.bincount(doc, length <= 3, n), words), np.log1p(longest), odds(distinct(marks.names(line_starts, line_ends), line_doc), lines),
    ]
    return np.stack(columns, 1)


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the statistics."""

    def each(batches):
        for batch in C.slices(batches):
            x = statistics(*C.byte_view(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    slim = docs.select(F.col(id_column).alias("doc_id"), C.text_or_empty(text).alias("text"))
    return slim.mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_column]}, x array<double>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Discriminant:
    """Class means, Cholesky factors of the inverse problem and log-priors; a curve on the log-density difference."""

    def __init__(self, moments: list[tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE):
        self.share = (moments[1][0] + 1.0) / (moments[0][0] + moments[1][0] + 2.0) if moments[0][0] and moments[1][0] else None
        self.none = moments[1][0] / (moments[0][0] + moments[1][0]) if moments[0][0] + moments[1][0] else 0.5
        self.intercept, self.slope = 0.0, 1.0
        if self.share is None:
            return
        means = [s / n for n, s, _ in moments]
        scatter = [q / n - np.outer(m, m) for (n, _, q), m in zip(moments, means, strict=True)]
        total = moments[0][0] + moments[1][0]
        pooled = sum(n * c for (n, _, _), c in zip(moments, scatter, strict=True)) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.means = [m / self.scale for m in means]
        self.factors = []
        for c in scatter:
            c = ((1 - shrink) * c + shrink * pooled) / np.outer(self.scale, self.scale)
            c = (1 - ridge) * c + ridge * np.diag(np.maximum(np.diag(c), 1e-3)) + 1e-4 * np.eye(len(c))
            lower = np.linalg.cholesky(c)
            self.factors.append((np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | good) - log p(x | bad), in units of which exp never overflows."""
        z = x / self.scale
        log = [-0.5 * (((z - m) @ inverse.T) ** 2).sum(1) - half for m, (inverse, half) in zip(self.means, self.factors, strict=True)]
        return np.clip(log[1] - log[0], -200, 200)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.share is None:
            return np.full(len(x), self.none)
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.arcsinh(self.difference(x)))))


def fit(known: DataFrame) -> Discriminant:
    """known: x, label (0 or 1). All rows count."""
    d = len(FEATURES)

    def sums(batches):
        got = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for k in (0, 1):
                z = x[y == k]
                got[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.record_batch([pa.array(np.repeat([0, 1], got.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(got.shape[1]), 2).astype(np.int32)), pa.array(got.ravel())], names=["k", "i", "v"])

    got = np.zeros((2, 1 + d + d * d))
    for k, i, v in known.select("x", "label").mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():
        got[k, i] = v
    model = Discriminant([(row[0], row[1 : 1 + d], row[1 + d :].reshape(d, d)) for row in got])
    if model.share is None:
        return model

    def graded(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(np.round(np.arcsinh(model.difference(_matrix(batch.column(0)))), 1)), batch.column(1)], names=["g", "label"])

    points = known.select("x", "label").mapInArrow(graded, "g double, label int").groupBy("g", "label").count().collect()  # tenths between -6 and 6
    x, y, w = (np.array([r[i] for r in points], float) for i in range(3))
    model.intercept, model.slope = logistic(x, y, w)
    return model


def classify(statistics_: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id and score of every row of `statistics_` (doc_id, x), learned from the labels where `train` holds."""
    known = labels.filter(F.col("label").isin(0, 1) & train).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    model = fit(statistics_.join(known, "doc_id"))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(model.probability(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return statistics_.select("doc_id", "x").mapInArrow(each, f"doc_id {dict(statistics_.dtypes)['doc_id']}, score double")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents`; rows with crc32(doc_id) mod 3 = 1 are held out."""
    x = C.settled(with_statistics(C.table(spark, folder, "documents")), "statistics")
    scored = classify(x, labelled(spark, folder, "quality"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
