"""Scoring of distinct texts against scoring of every row."""

from pyspark.sql import functions as F

from reviewlake.operators import models


def test_equal_texts_are_scored_once(spark):
    texts = ["good food here", "bad food here", "good service again", "cold soup again", "good food here"]
    df = spark.createDataFrame([(i, texts[i % 5], i % 5 + 1) for i in range(40)] + [(40, texts[0], None), (40, "unseen words", 1)], "review_id long, reviewText string, reviewRating int")
    features = models.fit_tfidf(df)
    model = models.bayes().fit(models.featurise(features, df.filter("reviewRating IS NOT NULL")))
    out = ["review_id", "reviewText", "reviewRating", "sentiment_score", "sentiment", "confidence", F.to_json("probabilities").alias("p")]
    scored = models.score_texts(model, features, df)
    assert sorted(map(str, scored.select(out).collect())) == sorted(map(str, models.score(model, models.featurise(features, df)).select(out).collect()))
    taken = scored.select(F.struct("reviewText", "confidence")).distinct().count()
    assert taken == 5 and scored.count() == df.count()
    # the texts are taken apart before the join, not in its rows
    assert "RegexTokenizer" not in scored._jdf.queryExecution().optimizedPlan().toString() and "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()
