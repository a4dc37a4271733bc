"""Models of the whole training part: no row is drawn, equal rows count as often as they occur."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from reviewlake.operators import models, sampling
from reviewlake.plans import model_queries as Q

WORDS = "good bad fine cold warm slow fast kind rude clean dirty fresh stale loud quiet".split()


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(WORDS, 4)), int(r), "train" if i % 8 else "val") for i, r in enumerate(rng.choice([1, 2, 5], 700, p=[0.1, 0.2, 0.7]))]
    return spark.createDataFrame([*rows, (None, 5, "train"), ("never rated", 5, "test")] + rows[:90], "reviewText string, reviewRating int, split string")


def test_whole_part_equals_one_row_each(spark, parts):
    """Weights, rows, vectors and model are those of `prepare`, which keeps every row."""
    data, plain = models.prepare_whole(parts), models.prepare(parts.fillna(""))
    assert data.rows == plain.rows == parts.filter("split = 'train'").count()
    assert models.vocabulary(data.features) == models.vocabulary(plain.features)
    key = lambda r: (r.label, tuple(r.features.indices), tuple(np.round(r.features.values, 12)))
    got, want = {}, {}
    for r in data.train.collect():
        assert key(r) not in got
        got[key(r)] = r.weight
    for r in plain.train.collect():
        want[key(r)] = want.get(key(r), 0.0) + r.weight
    assert got == pytest.approx(want) and len(got) < plain.rows
    a, b = (models.logistic(d.rows).setTol(1e-10).fit(d.train).coefficientMatrix.toArray() for d in (data, plain))
    assert np.allclose(a, b, atol=2e-3) and abs(a).max() > 0.1


def test_score_reviews_learns_from_every_training_row(spark, monkeypatch):
    held = []
    fit = models.logistic
    monkeypatch.setattr(models, "logistic", lambda rows: held.append(rows) or fit(rows, 3))
    monkeypatch.setattr(models, "prepare_whole", lambda parts, whole=models.prepare_whole: held.append(whole(parts)) or held[-1])
    got = Q.score_reviews(spark, DATA)
    reviews = Q.review_view.reviews(spark, DATA)
    train = sampling.stratified_split(reviews.select("review_id", "reviewRating")).filter("split = 'train'").count()
    assert held[0].train.agg(F.sum("n")).first()[0] == held[1] == train > 5 * Q.ROWS_PER_RATING
    assert got.count() == reviews.count()


def test_train_gbt_learns_from_every_training_row(spark, monkeypatch):
    boosting = models.boosting
    monkeypatch.setattr(models, "boosting", lambda rows, weight: boosting(rows, rounds=2, weight=weight))
    got = {r.split: r for r in Q.train_gbt(spark, DATA).collect()}
    want = {r.split: r["n"] for r in sampling.stratified_split(Q.review_view.reviews(spark, DATA).select("review_id", "reviewRating")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert {s: r.support for s, r in got.items()} == {s: want[s] for s in ("train", "val")} and want["train"] > 5 * Q.ROWS_PER_RATING


def test_boosting_weighs_a_row_as_often_as_it_stands(spark, parts, monkeypatch):
    """Trees of rows with weights are those of the repeated rows; sums by sorted keys equal those in an array."""
    from reviewlake.operators import boosting as B

    data = models.prepare_whole(parts)
    each = data.train.select("label", "features", "weight", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), "n")
    each = each.withColumn("weight", F.col("weight") / F.col("n")).repartition(3)
    models_of = [models.boosting(rounds=3, weight="weight").fit(df) for df in (data.train, each)]
    monkeypatch.setattr(B, "DENSE", 0)
    models_of.append(models.boosting(rounds=3, weight="weight").fit(data.train))
    for other in models_of[1:]:
        assert [[t.splits for t in trees] for trees in other.rounds] == [[t.splits for t in trees] for trees in models_of[0].rounds]
        assert np.allclose([x for _, x in other.losses], [x for _, x in models_of[0].losses])
