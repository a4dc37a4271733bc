import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA

from reviewlake.functions import distributed as ds
from reviewlake.operators import anomaly, bias, features, validation


def one(df):
    return df.first().asDict()


def test_labels_and_lengths(spark):
    df = spark.createDataFrame([(5, "abc"), (1, None), (7, ""), (None, "x")], "reviewRating int, reviewText string")
    got = features.add_label(features.add_text_length(df, pandas_compat=True)).collect()
    assert [(r.sentiment, r.text_length) for r in got] == [("excellent", 3), ("terrible", 3), ("unknown", 0), ("unknown", 1)]


def test_place_average_keeps_rows_without_place(spark):
    df = spark.createDataFrame([("A", 5), ("A", 2), (None, 1)], "placeName string, reviewRating int")
    got = sorted((str(r.placeName), r.restaurant_avg_rating) for r in features.add_place_average(df).collect())
    assert got == [("A", 3.5), ("A", 3.5), ("None", None)]
    with pytest.raises(ValueError, match="placeName"):
        features.add_place_average(df.drop("placeName"))


def test_range_and_type_checks(spark):
    df = spark.createDataFrame([(1, 5), (3, 10), (5, 300)], "reviewRating int, text_length int")
    assert one(validation.check_ratings(df)) == {"min": 1.0, "max": 5.0, "out_of_range_count": 0, "valid": True}
    assert one(validation.check_lengths(df))["mean"] == 105.0
    assert [r.valid for r in validation.check_types(df).collect()] == [True]


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "b"), (1, None)], "reviewRating int, reviewText string")
    got = {r.column: (r.missing_count, r.missing_percentage, r.is_critical) for r in validation.missing_report(df).collect()}
    assert got == {"reviewRating": (1, 25.0, True), "reviewText": (1, 25.0, False)}
    assert {r.kind: r.rows for r in validation.duplicate_report(df).collect()} == {"exact_duplicates": 2, "duplicate_texts": 2}


def test_gate_counts_critical_gaps(spark):
    df = spark.createDataFrame([(None, "p")] * 6, "reviewRating int, placeName string")
    got = one(validation.gate(df))
    assert got["passed"] is False and got["issues"].count(";") == 1 and got["exact_duplicates"] == 6
    assert one(validation.gate(spark.createDataFrame([(1, "p")], df.schema)))["passed"] is True


def test_empty_frame_reports(spark):
    df = spark.createDataFrame([], "reviewRating int, text_length int")
    assert bias.distribution(df).count() == 0
    assert one(bias.verdict(df))["bias"] == "none"
    assert one(bias.by_length(df))["short_reviews_count"] == 0


def test_moments(spark):
    df = spark.createDataFrame([(r,) for r in (1, 2, 5, 5, 5)], "reviewRating int")
    got = one(bias.moments(df))
    assert got["skewness"] == pytest.approx(-0.75598, abs=1e-5) and got["median_rating"] == 5
    single = one(bias.moments(df.limit(1)))
    assert single["std_rating"] is None and single["skewness"] is None


def test_published_ratios_mean_positive_bias(spark):
    ratings = [5] * 786 + [1] * 148 + [3] * 66
    df = spark.createDataFrame([(r,) for r in ratings], "reviewRating int")
    assert one(bias.ratios(df)) == {"positive_ratio": 0.786, "negative_ratio": 0.148, "neutral_ratio": 0.066}
    assert one(bias.verdict(df))["bias"] == "positive"


def test_categories_and_months(spark):
    df = spark.createDataFrame(
        [("A", 5, "2024-01-01"), ("B", 4, "2024-01-15"), ("A", 3, "2024-02-01"), ("C", 2, "oops"), (None, 1, None)],
        "placeName string, reviewRating int, reviewDate string")
    assert {r.category: r["count"] for r in bias.by_category(df, "placeName").collect()} == {"A": 2, "B": 1, "C": 1}
    got = one(bias.imbalance(df, "placeName"))
    assert (got["imbalance_ratio"], got["most_common"], got["least_common"], got["null_count"]) == (2.0, "A", "B", 1)
    assert sorted((str(r.month), r["count"]) for r in bias.monthly(df).collect()) == [("2024-01-01", 2), ("2024-02-01", 1)]


def test_length_bias(spark):
    df = spark.createDataFrame([(5, 3), (10, 4), (100, 5), (150, 1)], "text_length int, reviewRating int")
    got = one(bias.by_length(df))
    assert (got["short_reviews_count"], got["long_reviews_count"], got["avg_rating_short"], got["avg_rating_long"]) == (2, 1, 3.5, 1.0)


def test_outliers_dates_and_ids(spark):
    data = [(i, 10, "2020-01-01") for i in range(30)] + [(99, 1000, "1980-01-01"), (98, None, "2050-01-01")]
    df = spark.createDataFrame(data, "review_id long, text_length int, reviewDate string")
    assert [(r.subject, r["count"], r.ids) for r in anomaly.z_scores(df).collect()] == [("text_length", 1, "99")]
    assert {r.subject: r.ids for r in anomaly.dates(df, "2030-01-01").collect()} == {"future_dates": "98", "old_dates": "99"}
    assert anomaly.z_scores(df.filter("text_length = 10")).count() == 0


def test_first_ids_are_the_smallest_ten(spark):
    df = spark.range(1000).select(F.col("id").alias("review_id"), F.lit("ok").alias("reviewText"), F.lit(2).alias("text_length"))
    got = anomaly.short_texts(df).first()
    assert got["count"] == 1000 and got.ids == ",".join(map(str, range(10)))


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0], [5.0] * 700 + list(range(300)), [0.1 * i ** 2 for i in range(997)]])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ds.percentiles_of_counts(ds.value_counts(df, ["v"]), [0.25, 0.5, 0.9]).collect()
    for r in got:
        assert r.value == pytest.approx(np.quantile(values, r.prob), abs=1e-9)
    assert len(got) == 3


@pytest.mark.parametrize("buckets", [2, 16, 300])
def test_running_totals_with_a_hot_group(spark, buckets):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("g"), (F.col("id") * 7919 % 3001).alias("k"), F.col("id").alias("v"))
    got = ds.running_totals(ds.with_bucket(df, F.col("k"), buckets), ["g"], ["k"], ["v"]).toPandas()
    want = df.toPandas().sort_values("k")
    want["cum_v"] = want.groupby("g", dropna=False)["v"].cumsum()
    assert got.sort_values("k")["cum_v"].tolist() == want["cum_v"].tolist()


def test_buckets_are_balanced_and_ordered(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"))
    got = ds.with_bucket(df, F.col("k"), 100).toPandas().sort_values("k")
    assert got["__b"].is_monotonic_increasing and got["__b"].max() == 99
    assert got.groupby("__b").size().max() < 80


def test_hot_group_totals_are_exact(spark):
    df = spark.range(3000).select(F.lit("all").alias("g"), F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    got = ds.running_totals(ds.with_bucket(df, F.col("k"), 50), ["g"], ["k"], ["v"]).toPandas()
    assert (got["cum_v"] == got["k"] + 1).all()


def test_settled_frames_of_reports_hold_no_texts(spark, monkeypatch):
    from reviewlake.operators import bias
    from reviewlake.plans import prep_queries

    kept = []
    keep = prep_queries.settled
    for module in (prep_queries, bias):  # the bias report keeps its cube
        monkeypatch.setattr(module, "settled", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    for query in ("validation_gate", "anom_zscore", "anomaly_report", "bias_report"):
        prep_queries.QUERIES[query](spark, DATA)
    assert len(kept) == 4
    for df in kept:
        assert "reviewText" not in df.columns or df.filter(F.length("reviewText") > 50).isEmpty()


def test_place_means_leave_the_rows_where_they_are(spark):
    from reviewlake.operators import features

    df = spark.range(1000).selectExpr("id AS review_id", "concat('p', id % 7) AS placeName", "CAST(id % 5 AS INT) AS reviewRating", "repeat('x', 500) AS reviewText")
    plan = features.add_place_average(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(placeName" not in plan


def test_exact_duplicates_keep_the_first_and_move_no_text(spark):
    from reviewlake.operators import cleaning

    rows = [(3, "a", "t"), (1, "a", "t"), (2, "a", None), (9, "a", None), (5, None, "t"), (4, "b", "t")]
    df = spark.createDataFrame(rows, "review_id long, placeName string, reviewText string")
    got = cleaning.drop_exact_duplicates(df, ["placeName", "reviewText"])
    assert sorted(map(str, got.collect())) == sorted(map(str, df.filter("review_id IN (1, 2, 5, 4)").select("placeName", "reviewText").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
