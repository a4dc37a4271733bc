"""The report from counts against the tables that read the rows, and reports over loads against one over all."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import bias
from reviewlake.session import scratch_dir

SCHEMA = "reviewRating int, text_length int, sentiment string, placeName string, reviewDate date"


def rows(seed, n):
    rng = random.Random(seed)
    return [(
        rng.choice([1, 2, 3, 4, 5, 5, 5, None]), rng.choice([None, 0, 5, 19, 20, 21, rng.randrange(400)]), rng.choice(["positive", "negative", None]),
        rng.choice(["A", "B", "C", "hot", "hot", "hot", None]), rng.choice([None, dt.date(2001, rng.randint(1, 12), rng.randint(1, 28))]),
    ) for _ in range(n)]


@pytest.fixture
def frame(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


def table(df):
    return sorted(((r.section, r.key, r.metric, r.value) for r in df.collect()), key=str)


def by_rows(df):
    """What the separate tables say, in the form of the report."""
    out, one = [], lambda section, row, names: [(section, "all", m, None if row[m] is None else float(row[m])) for m in names]
    for r in bias.distribution(df).collect():
        out += [("rating_distribution", str(r.reviewRating), m, float(r[m])) for m in ("count", "share")]
    out += one("rating_moments", bias.moments(df).first(), ("mean_rating", "median_rating", "std_rating", "skewness"))
    out += one("rating_ratios", bias.ratios(df).first(), ("positive_ratio", "negative_ratio", "neutral_ratio"))
    out += one("text_length", bias.by_length(df).first(), ("short_reviews_count", "long_reviews_count", "avg_rating_short", "avg_rating_long"))
    for c in bias.CATEGORIES:
        for r in bias.by_category(df, c).collect():
            out += [(c, r.category, m, None if r[m] is None else float(r[m])) for m in ("count", "percentage", "avg_rating", "rating_std")]
        out += one(f"{c}_imbalance", bias.imbalance(df, c).first(), ("imbalance_ratio", "null_count"))
    for r in bias.monthly(df).collect():
        out += [("monthly_trend", r.month.strftime("%Y-%m"), m, None if r[m] is None else float(r[m])) for m in ("mean_rating", "std_rating", "count")]
    return sorted([*out, ("verdict", bias.verdict(df).first().bias, "bias", 1.0)], key=str)


@pytest.mark.parametrize("data", [rows(1, 300), rows(2, 1), rows(3, 3), [(4, 10, "positive", "A", None)] * 9, [(None, None, None, None, None)] * 4])
def test_report_equals_the_separate_tables(frame, data):
    assert table(bias.bias_report(frame(data))) == by_rows(frame(data))


def test_loads_add_up(spark, frame):
    loads, store = [rows(7, 120), rows(8, 90), rows(9, 1)], scratch_dir(spark, "cubes")
    for name, load in enumerate(loads):
        bias.save_cube(frame(load), store, f"d{name}")
    bias.save_cube(frame(loads[1]), store, "d1")  # a repeated run replaces itself
    report = bias.stored_report(spark, store)
    assert table(report) == table(bias.bias_report(frame([r for load in loads for r in load])))


def test_rows_are_scanned_once(spark, frame):
    path = scratch_dir(spark, "rows")
    frame(rows(4, 50)).write.parquet(path)
    report = bias.bias_report(spark.read.parquet(path).withColumn("reviewRating", F.col("reviewRating") + 0))
    assert all("cube" in f for f in report.inputFiles())
