"""Joint boosting against a plain version, and what a fit must show."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from reviewlake.operators import boosting as B


def made(rows=150, width=8, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((rows, width)) * (rng.random((rows, width)) < 0.5), 3)
    y = (x[:, :3] + 0.2 * rng.random((rows, 3))).argmax(1)
    return x, y


def frame(spark, x, y):
    vector = lambda r: Vectors.sparse(len(r), {i: float(v) for i, v in enumerate(r) if v})
    return spark.createDataFrame([(i, vector(r), float(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], ["id", "features", "label"])


def plain(x, y, rounds, depth, step, least):
    """Scores of the rows, by definition: every split of every bin tried, row sets as masks."""
    low = np.array([c[c > 0].min() for c in x.T])
    width = np.array([(c.max() - lo) / B.BINS for c, lo in zip(x.T, low, strict=True)])
    bins = np.where(x == 0, 0, np.clip(((x - low) / width).astype(int), 0, B.BINS - 1) + 1)
    classes = y.max() + 1
    scores = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))

    def grow(mask, g, h, left):
        best = None
        for f in range(x.shape[1]) if left else ():
            for b in sorted(set(bins[mask, f].tolist()) - {0}):
                r, m = mask & (bins[:, f] >= b), mask & (bins[:, f] < b)
                if min(r.sum(), m.sum()) >= least:
                    gain = round(g[r].sum() ** 2 / r.sum() + g[m].sum() ** 2 / m.sum() - g[mask].sum() ** 2 / mask.sum(), 9)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, r, m)
        if best is None:
            return mask * (g[mask].sum() / max(h[mask].sum(), 1e-12))
        return grow(best[1], g, h, left - 1) + grow(best[2], g, h, left - 1)

    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        everything = np.ones(len(y), bool)
        scores = scores + np.stack([step * (classes - 1) / classes * grow(everything, (y == k) - p[:, k], p[:, k] * (1 - p[:, k]), depth) for k in range(classes)], 1)
    return scores


@pytest.mark.parametrize("least", [1, 12])
def test_scores_equal_the_plain_version(spark, monkeypatch, least):
    monkeypatch.setattr(B, "RENEW", 2)
    x, y = made()
    df = frame(spark, x, y).repartition(3)
    model = B.JointBoosting(maxIter=5, maxDepth=3, stepSize=0.3, minInstancesPerNode=least).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    want = plain(x, y, 5, 3, 0.3, least)
    assert np.allclose([got[i].rawPrediction.toArray() for i in range(len(y))], want, atol=1e-6)
    assert [got[i].prediction for i in range(len(y))] == want.argmax(1).tolist()
    assert np.allclose([got[i].probability.toArray() for i in range(len(y))], B.softmax(want), atol=1e-6)
    losses = [value for _, value in model.losses]
    assert [n for n, _ in model.losses] == [0, 2, 4, 5] and all(b < a for a, b in zip(losses, losses[1:]))
    p = B.softmax(want)
    assert losses[-1] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())
    assert model.featureImportances.toArray()[:3].sum() > 0.7


def test_loss_falls_every_round_also_with_samples_of_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "RENEW", 1)
    x, y = made(seed=9)
    model = B.JointBoosting(maxIter=6, maxDepth=2, subsamplingRate=0.7).fit(frame(spark, x, y).coalesce(1))
    losses = [value for _, value in model.losses]
    assert len(losses) == 7 and all(b < a for a, b in zip(losses, losses[1:]))


def test_no_rows_one_class_and_negative_values(spark):
    x, y = made(30)
    df = frame(spark, x, y)
    with pytest.raises(ValueError):
        B.JointBoosting().fit(df.limit(0))
    with pytest.raises(ValueError):
        B.JointBoosting(maxIter=1).fit(frame(spark, -x, y))
    same = B.JointBoosting(maxIter=2).fit(frame(spark, x, np.zeros(30, int)))
    assert {r.prediction for r in same.transform(df).collect()} == {0.0} and same.transform(df.limit(0)).count() == 0


def test_the_driver_gets_splits_and_not_sums(spark):
    """What a pass brings to the driver does not grow with the features, and is the best of all sums."""
    import pickle

    def passed(width):
        x, y = made(rows=60, width=width)
        low, step = np.array([c[c > 0].min() if c.any() else 0.0 for c in x.T]), np.full(width, 1 / B.BINS)
        rows = [B.Rows(block_of(x[i::3], y[i::3]), low, step, np.zeros(3), i) for i in range(3)]
        sent = ([], [B.Tree() for _ in range(3)], 0, width, (1, 0, 1.0))
        state = spark.sparkContext.parallelize(rows, 3)
        got = list(B.best_splits(state, spark.sparkContext.broadcast(sent), width, 1, 1, 3))
        parts = [r.sums(*sent) for r in rows]
        want = list(B.choose(*B.added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), width, 1, 1))
        assert [(k, n, s[:2]) for k, n, _, s in got] == [(k, n, s[:2]) for k, n, _, s in want]
        assert all(np.allclose(a[2], b[2]) and np.allclose(a[3][3], b[3][3]) for a, b in zip(got, want, strict=True))
        return len(pickle.dumps(got))

    assert abs(passed(400) - passed(8)) < 200


def block_of(x, y):
    vector = lambda r: Vectors.sparse(len(r), {i: float(v) for i, v in enumerate(r) if v})
    return next(iter(B.packed([(vector(r), int(k), 1.0) for r, k in zip(x, y, strict=True)])))
