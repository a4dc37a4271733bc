"""Training rows drawn alone, and vectors of counts, against the whole way."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewlake.functions import term_vectors as TV
from reviewlake.operators import models, sampling


def test_training_rows_drawn_alone_are_those_of_the_whole_split(spark):
    rows = [(i * 7 + 1, f"text {i}", None if i % 50 == 0 else (5 if i % 3 else i % 4 + 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "review_id long, reviewText string, reviewRating int")
    for target in (20, 150):  # below and above the rows of the small classes
        whole = sampling.training_sets(df, target).filter("split = 'train'").collect()
        alone = sampling.training_part(df, target).collect()
        assert sorted((r.review_id, r.draw, r.reviewText, r.reviewRating, r.split) for r in alone) == sorted((r.review_id, r.draw, r.reviewText, r.reviewRating, r.split) for r in whole)
    assert sampling.training_part(df, 20).rdd.getNumPartitions() == 1


def test_drawing_moves_only_the_buckets_of_drawn_rows(spark):
    df = spark.range(40000).select(F.col("id").alias("review_id"), F.lit("t").alias("reviewText"), F.lit(5).alias("reviewRating"))
    held = sum(x for x in (8000, 4000))
    got = sampling.ranked(df, "reviewRating", "review_id", within=lambda n: (F.lit(held), F.lit(held + 10))).collect()
    assert sorted(r["rank"] for r in got) == list(range(held + 1, held + 11)) and {r.group_rows for r in got} == {40000}


def test_vectors_equal_those_of_the_stages(spark):
    texts = [
        "The FOOD was good, the food was cold!", "a b c", "", None, "x_1 x_1 x_1", "Kelvin Kelvin İstanbul stanbul", "café naïve caf",
        "good food", "end", "end of a good one", "food was good the food", "tail good",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, reviewText string, reviewRating int").coalesce(1)
    features = models.fit_tfidf(df.filter("reviewText IS NOT NULL"), min_df=1, max_df=1.0)
    counted = {r.id: r.counts for r in TV.with_counts(df.select("id", "reviewText"), "reviewText", models.vocabulary(features)).collect()}
    staged = features.transform(df.filter("reviewText IS NOT NULL")).select("id", "counts").collect()
    assert len(counted) == len(texts) and counted[3].numNonzeros() == 0
    for r in staged:
        assert counted[r.id] == r.counts and (counted[r.id].indices == r.counts.indices).all(), texts[r.id]


def test_terms_do_not_cross_texts_whatever_the_step(monkeypatch):
    terms = TV.Terms(["ab", "ab cd", "ab cd ab"])
    texts = pa.array([b"ab cd", b"ab", b"", b"ab cd ab", b"cd"], pa.large_binary())
    of, places, n = terms.counts(texts)
    assert list(zip(of.tolist(), places.tolist(), n.tolist())) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (3, 0, 2), (3, 1, 1), (3, 2, 1)]
    monkeypatch.setattr(TV, "STEP", 4)
    parts = list(TV._steps(texts))
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts)
    assert np.array_equal(np.concatenate([terms.counts(p)[2] for p in parts]), n)
