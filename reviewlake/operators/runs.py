"""Run aggregates over triaged reviews: summary, running mean, latest, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import n_buckets, running_totals, with_bucket

LATEST = 50


def batch_summary(triaged: DataFrame, labels=lx.LABELS_AMAZING) -> DataFrame:
    """Rows (label, total, successful, failed, count, percentage) for every label, zeros included."""
    ok = F.col("status") == "success"
    counts = [F.count_if(ok & (F.col("sentiment") == label)).alias(label) for label in labels]
    wide = triaged.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), *counts)
    long = wide.unpivot(["total", "successful"], list(labels), "label", "count")
    return long.select(
        "label", "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), "count",
        F.coalesce(F.round(F.col("count") * 100.0 / F.nullif(F.col("successful"), F.lit(0)), 2), F.lit(0.0)).alias("percentage"),
    )


def label_counters(triaged: DataFrame) -> DataFrame:
    """Count and share of the labels that occur among successes."""
    counts = triaged.filter("status = 'success'").groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("sentiment", "count", F.round(F.col("count") / total, 6).alias("share"))


def _day_and_id(df: DataFrame, day: str, row_id: str) -> Column:
    """A double that does not fall along (day, id): the day, and how far the id lies between the least and the largest one."""
    low, high = (df.agg(f(F.col(row_id).cast("double"))).scalar() for f in (F.min, F.max))
    return F.unix_date(day) + (F.col(row_id).cast("double") - low) / (high - low + 1.0)


def running_confidence(triaged: DataFrame, group: str = "placeName") -> DataFrame:
    """Per row, in (date, id) order within its group: totals so far and mean confidence of the successes.

    A hot place is cut by day and by id range inside the day, so no task holds
    a whole place. Only ids, dates and confidences travel, and sums are decimal,
    so the result does not depend on how rows were partitioned.
    """
    ok = F.col("status") == "success"
    slim = triaged.select(
        "review_id", group, "reviewDate",
        F.lit(1).cast("long").alias("n"),
        ok.cast("long").alias("good"),
        F.when(ok, F.col("confidence")).otherwise(0.0).cast("decimal(20,12)").alias("sure"),
    )
    placed = with_bucket(slim, _day_and_id(slim, "reviewDate", "review_id"), n_buckets(slim))
    cum = running_totals(placed, [group], ["reviewDate", "review_id"], ["n", "good", "sure"])
    return cum.select(
        "review_id", group,
        F.col("cum_n").alias("total_processed"),
        F.col("cum_good").alias("successful"),
        (F.col("cum_n") - F.col("cum_good")).alias("failed"),
        (F.col("cum_sure").cast("double") / F.nullif(F.col("cum_good"), F.lit(0))).alias("avg_confidence"),
    )


def latest(df: DataFrame, order: list[str], n: int = LATEST) -> DataFrame:
    """The newest `n` rows; planned as a distributed top-k."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
