"""Fits that the built-in learners make, checked from outside: gradients at the optimum, probabilities and terms from coefficients."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewlake.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 9)) * (rng.random((200, 9)) < 0.5)
    y = (x[:, :5] + 0.4 * rng.random((200, 5))).argmax(1)
    df = spark.createDataFrame([(Vectors.dense(r), float(k)) for r, k in zip(x, y, strict=True)], ["features", "label"])
    return x, y, models.class_weights(df).cache()


def probabilities(model, x):
    scores = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_logistic_gradient_vanishes(data, c):
    """Of mean weighted log loss plus |w|^2 / (2 C rows), intercepts free; means are over the sum of weights."""
    x, y, df = data
    model = models.logistic(len(y), c=c).fit(df)
    weight = len(y) / (len(set(y.tolist())) * np.bincount(y)[y])
    pull = (probabilities(model, x) - np.eye(5)[y]) * weight[:, None] / weight.sum()
    gradient = pull.T @ x + model.coefficientMatrix.toArray() / (c * len(y))
    assert abs(gradient).max() < 1e-4 and abs(pull.sum(0)).max() < 1e-4


def test_scores_follow_from_coefficients(data):
    x, _, df = data
    model = models.logistic(len(x)).fit(df)
    got = models.score(model, df.select("features")).collect()
    expected = {tuple(r): p for r, p in zip(x, probabilities(model, x), strict=True)}
    for r in got:
        p = expected[tuple(r.features.toArray())]
        assert r.sentiment_score == p.argmax() + 1 and r.confidence == pytest.approx(p.max(), abs=1e-9)
        assert sorted(r.probabilities.values()) == pytest.approx(sorted(p), abs=1e-9)


def test_bayes_probabilities_by_counts(data, spark):
    x, y, df = data
    model = models.bayes(alpha=0.1).fit(df)
    sums = np.stack([x[y == k].sum(0) for k in range(5)])
    theta = np.log((sums + 0.1) / (sums.sum(1, keepdims=True) + 0.1 * x.shape[1]))
    assert np.allclose(model.theta.toArray(), theta)


def test_forest_votes_are_those_of_its_trees(data):
    x, y, df = data
    model = models.forest(trees=7, depth=4).fit(df)
    assert len(model.trees) == 7 and max(t.depth for t in model.trees) <= 4
    rows = df.select("features").limit(20).withColumn("id", F.monotonically_increasing_id()).cache()
    voted = np.array([r.probability.toArray() for r in model.transform(rows).orderBy("id").collect()])
    each = [np.array([r.probability.toArray() for r in t.transform(rows).orderBy("id").collect()]) for t in model.trees]
    assert np.allclose(voted, np.mean(each, 0), atol=1e-9)
