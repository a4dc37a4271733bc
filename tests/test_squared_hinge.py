"""The distributed squared-hinge fit against a dense Newton solution and its own certificate."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from reviewlake.operators.squared_hinge import SquaredHinge


def made(rows=240, width=12, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((rows, width)) * (rng.random((rows, width)) < 0.4)
    y = (x[:, :classes] + 0.3 * rng.random((rows, classes))).argmax(1)
    return x, y, np.where(y == 0, 1.5, 0.8)


def frame(spark, x, y, weight, sparse=True):
    vector = (lambda r: Vectors.sparse(len(r), {i: float(v) for i, v in enumerate(r) if v})) if sparse else (lambda r: Vectors.dense(r))
    return spark.createDataFrame([(vector(r), float(k), float(s)) for r, k, s in zip(x, y, weight, strict=True)], ["features", "label", "weight"])


def gradient(x, y, weight, reg, w):
    """By the definition, of one class: value, gradient and generalised second derivative."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    slack = np.maximum(0, 1 - y * (wide @ w))
    value = reg / 2 * w @ w + (weight * slack**2).mean()
    slope = reg * w - 2 * (wide * (weight * y * slack)[:, None]).mean(0)
    live = (slack > 0) * weight
    return value, slope, reg * np.eye(len(w)) + 2 * (wide * live[:, None]).T @ wide / len(x)


@pytest.fixture(scope="module")
def fitted(spark):
    x, y, weight = made()
    df = frame(spark, x, y, weight).repartition(3)
    return x, y, weight, df, SquaredHinge(regParam=0.01, weightCol="weight", tol=1e-8).fit(df)


def test_equals_a_dense_newton_solution(fitted):
    x, y, weight, _, model = fitted
    assert model.residual <= 1e-7
    for k, binary in enumerate(model.models):
        sign = np.where(y == k, 1.0, -1.0)
        w = np.zeros(x.shape[1] + 1)
        for _ in range(200):
            _, slope, second = gradient(x, sign, weight, 0.01, w)
            w -= 0.5 * np.linalg.solve(second, slope)
        got = np.append(binary.coefficients.toArray(), binary.intercept)
        assert np.allclose(got, w, atol=1e-5)
        assert abs(gradient(x, sign, weight, 0.01, got)[1]).max() <= 1e-7


def test_predicts_the_largest_margin(fitted):
    x, _, _, df, model = fitted
    margins = np.stack([x @ m.coefficients.toArray() + m.intercept for m in model.models], 1)
    got = {tuple(r.features.toArray()): r.prediction for r in model.transform(df).collect()}
    assert all(got[tuple(r)] == float(m.argmax()) for r, m in zip(x, margins, strict=True))


def test_dense_rows_weights_nulls_and_missing_classes(spark, fitted):
    x, y, weight, df, model = fitted
    dense = SquaredHinge(regParam=0.01, weightCol="weight").fit(frame(spark, x, y, weight, sparse=False))
    assert np.allclose(dense.models[0].coefficients.toArray(), model.models[0].coefficients.toArray(), atol=1e-4)
    bare = df.union(spark.createDataFrame([(None, 0.0, 1.0), (df.first().features, None, 1.0)], df.schema))
    again = SquaredHinge(regParam=0.01, weightCol="weight", tol=1e-6).fit(bare)
    assert np.allclose(again.models[1].coefficients.toArray(), model.models[1].coefficients.toArray(), atol=1e-4)
    gap = SquaredHinge(regParam=0.01, tol=1e-4).fit(frame(spark, x, np.where(y == 1, 2, y), weight))
    assert not gap.transform(df).filter("prediction = 1").count()
    with pytest.raises(ValueError):
        SquaredHinge().fit(df.limit(0))


def test_settings_reach_the_search(spark, fitted):
    from reviewlake.operators import models

    _, _, _, df, _ = fitted
    settings = [{"regParam": 1.0, "maxIter": 5}, {"regParam": 0.1, "maxIter": 10}]
    best, rows = models.cross_validate(models.linear_svc(df.count()), df, settings, folds=2)
    assert rows.count() == 2 and 0 < rows.agg({"mean_f1": "max"}).first()[0] <= 1
    assert len(best.models) == 3
