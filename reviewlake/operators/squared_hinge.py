"""Linear classifiers with the squared hinge loss, one class against the rest, fitted for all classes at once.

For class k, with y = 1 for its rows and -1 for others, the fit minimises over w and b

    regParam / 2 * (|w|^2 + b^2)  +  mean over rows of  weight * max(0, 1 - y * (w.x + b))^2

which is the usual C formulation at C = 1 / (regParam * rows). The intercept is regularised as a feature that is always one.

Rows are packed once into sparse blocks. Each step sums losses and gradients of all classes over the blocks by a tree of
partial sums; the driver holds a few vectors of classes x features (bounded by the vocabulary) for limited-memory BFGS. A
lost executor's blocks are packed again from the rows. Scoring is the built-in one, inside the JVM.

The residual that the fit reports, the largest gradient entry at its end, is the certificate of the optimum: the problem is
strictly convex, so a zero residual is the one solution. A class without rows gets a classifier that says no. Rows with a
null label, weight or features are left out; with none left the fit raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVCModel, OneVsRestModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasRawPredictionCol,
    HasRegParam,
    HasTol,
    HasWeightCol,
)
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.session import ship_package

BLOCK_ROWS = 4096
MEMORY = 10


class Block:
    """Sparse rows: the row, column and value of each entry; label and weight of each row."""

    def __init__(self, rows: list):
        sizes = [len(r[0].indices) for r in rows]
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.column = np.concatenate([r[0].indices for r in rows]).astype(np.int64)
        self.value = np.concatenate([r[0].values for r in rows])
        self.label = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], float)

    def part(self, at: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of losses and its gradient at the coefficients `at`: classes x (features + 1), the intercept last."""
        classes, width = at.shape
        gradient, loss = np.empty_like(at), 0.0
        for k in range(classes):
            sign = np.where(self.label == k, 1.0, -1.0)
            margin = np.bincount(self.row, self.value * at[k, self.column], len(sign)) + at[k, -1]
            slack = np.maximum(0.0, 1.0 - sign * margin)
            loss += float((self.weight * slack * slack).sum())
            pull = -2.0 * self.weight * sign * slack
            gradient[k, :-1] = np.bincount(self.column, self.value * pull[self.row], width - 1)
            gradient[k, -1] = pull.sum()
        return loss, gradient


def packed(rows: Iterator) -> Iterator[Block]:
    """Blocks of BLOCK_ROWS rows; dense vectors become sparse ones."""
    held = []
    for features, label, weight in rows:
        if not hasattr(features, "indices"):
            features = Vectors.sparse(len(features), {i: float(x) for i, x in enumerate(features.toArray()) if x})
        held.append((features, label, weight))
        if len(held) == BLOCK_ROWS:
            yield Block(held)
            held = []
    if held:
        yield Block(held)


def minimise(value_and_gradient, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Limited-memory BFGS with halved steps: (point, largest gradient entry there, steps taken)."""
    x = start
    value, gradient = value_and_gradient(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(max_iter):
        if abs(gradient).max() <= tol:
            return x, float(abs(gradient).max()), step
        towards, shares = -gradient, []
        for s, d, rho in reversed(moves):
            shares.append(rho * (s * towards).sum())
            towards = towards - shares[-1] * d
        if moves:
            s, d, rho = moves[-1]
            towards = towards / (rho * (d * d).sum())
        else:
            towards = towards / max(1.0, float(np.sqrt((gradient * gradient).sum())))
        for (s, d, rho), share in zip(moves, reversed(shares), strict=True):
            towards = towards + (share - rho * (d * towards).sum()) * s
        slope, length = float((gradient * towards).sum()), 1.0
        while True:
            new = x + length * towards
            new_value, new_gradient = value_and_gradient(new)
            if new_value <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        if new_value >= value:  # no better value within the precision of doubles
            return x, float(abs(gradient).max()), step
        s, d = new - x, new_gradient - gradient
        curve = float((s * d).sum())
        if curve > 1e-12 * float((d * d).sum()):
            moves = [*moves[-MEMORY + 1 :], (s, d, 1.0 / curve)]
        x, value, gradient = new, new_value, new_gradient
    return x, float(abs(gradient).max()), max_iter


class SquaredHinge(
    Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasRawPredictionCol, HasRegParam, HasMaxIter, HasTol
):
    """Estimator of `OneVsRestModel`s of linear classifiers; labels are 0, 1, ... as doubles.

    The model carries `residual` (see the module) and `steps`.
    """

    @keyword_only
    def __init__(self, *, regParam: float | None = None, maxIter: int | None = None, tol: float | None = None, weightCol: str | None = None,
                 featuresCol: str | None = None, labelCol: str | None = None, predictionCol: str | None = None,
                 rawPredictionCol: str | None = None):
        super().__init__()
        self._setDefault(regParam=0.01, maxIter=1500, tol=1e-6)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        ship_package(dataset.sparkSession)
        features, label = F.col(self.getFeaturesCol()), F.col(self.getLabelCol())
        weight = F.col(self.getWeightCol()) if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(features.alias("x"), label.cast("int").alias("y"), weight.cast("double").alias("s")).dropna()
        blocks = rows.rdd.mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            first = rows.first()
            if first is None:
                raise ValueError("no rows to fit")
            n, classes = blocks.map(lambda b: (len(b.label), int(b.label.max()) + 1)).reduce(lambda a, b: (a[0] + b[0], max(a[1], b[1])))
            reg = self.getRegParam()

            def value_and_gradient(at: np.ndarray):
                sent = rows.sparkSession.sparkContext.broadcast(at)  # classes x vocabulary
                loss, gradient = blocks.map(lambda b: b.part(sent.value)).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
                sent.destroy()
                return loss / n + reg / 2 * float((at * at).sum()), gradient / n + reg * at

            start = np.zeros((max(2, classes), first.x.size + 1))
            at, residual, steps = minimise(value_and_gradient, start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        model = OneVsRestModel([self._binary(w) for w in at])
        for name in ("featuresCol", "predictionCol", "rawPredictionCol"):
            model.set(model.getParam(name), self.getOrDefault(name))
        model.residual, model.steps = residual, steps
        return model

    @staticmethod
    def _binary(coefficients: np.ndarray) -> LinearSVCModel:
        """The built-in linear classifier with given coefficients, the intercept last."""
        java = JavaParams._new_java_obj(
            "org.apache.spark.ml.classification.LinearSVCModel", "squared_hinge", Vectors.dense(coefficients[:-1]), float(coefficients[-1])
        )
        return LinearSVCModel(java)
