"""Metric differences between slices of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.metrics import METRICS, pair_counts, weighted_metrics

SLICES = ("authorName", "provider", "reviewRating", "placeName")
THRESHOLD = 0.1
MIN_ROWS = 10


def slice_metrics(df: DataFrame, slices: Sequence[str] = SLICES, min_rows: int = MIN_ROWS) -> DataFrame:
    """Metrics per (dimension, value) with at least `min_rows` rows; null values are no slice.

    Predictions are read once: rows become (dimension, value, y, p) and are
    counted with map-side combining, so a slice with most rows is a few counts.
    """
    present = [c for c in slices if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in present
    ])
    long = df.select("y", "p", F.explode(pairs).alias("s")).select("y", "p", "s.*").filter("value IS NOT NULL")
    keys = ["dimension", "value"]
    return weighted_metrics(pair_counts(long, keys), keys).filter(F.col("support") >= min_rows)


def overall_metrics(df: DataFrame) -> DataFrame:
    return weighted_metrics(pair_counts(df))


def disparities(slices: DataFrame, overall: DataFrame) -> DataFrame:
    """Spread of each metric over the slices of a dimension, and its largest distance from the overall value."""
    long = slices.unpivot(["dimension", "value"], list(METRICS), "metric", "x")
    whole = overall.unpivot([], list(METRICS), "metric", "overall")
    joined = long.join(F.broadcast(whole), "metric")  # four rows: one per metric
    x = F.col("x")
    return joined.groupBy("dimension", "metric").agg(
        F.max(x).alias("max"), F.min(x).alias("min"), (F.max(x) - F.min(x)).alias("range"),
        F.stddev_pop(x).alias("std"), F.avg(x).alias("mean"), F.max("overall").alias("overall"),
        F.max(F.abs(x - F.col("overall"))).alias("max_deviation"),
    )


def violations(spread: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    r = F.col("range")
    return spread.filter(r > threshold).select(
        "dimension", "metric", "range", F.lit(threshold).alias("threshold"),
        F.when(r > threshold * 2, "HIGH").otherwise("MEDIUM").alias("severity"),
    )


def recommendations(found: DataFrame) -> DataFrame:
    """One row per severity that occurs and one per affected dimension: (priority, issue, suggestion)."""
    by_severity = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("severity").alias("priority"),
        F.concat(F.col("n").cast("string"), F.lit(" fairness violations of severity "), F.col("severity")).alias("issue"),
        F.when(F.col("severity") == "HIGH", "Train again on balanced data or with fairness constraints")
        .otherwise("Watch these slices and improve them one by one").alias("suggestion"),
    )
    by_dimension = found.select("dimension").distinct().select(
        F.lit("MEDIUM").alias("priority"),
        F.concat(F.lit("Metrics differ across "), F.col("dimension")).alias("issue"),
        F.concat(F.lit("Add or reweight data for the weak values of "), F.col("dimension")).alias("suggestion"),
    )
    return by_severity.unionByName(by_dimension)


def fairness_report(df: DataFrame, slices: Sequence[str] = SLICES) -> DataFrame:
    """Everything as rows (section, dimension, key, metric, value, note)."""
    s, o = slice_metrics(df, slices), overall_metrics(df)
    d = disparities(s, o)
    v = violations(d)
    none = F.lit(None).cast("string")
    names = [*METRICS, "support"]
    spread = ["max", "min", "range", "std", "mean", "overall", "max_deviation"]

    def long(frame: DataFrame, section: str, dimension, key, columns: list[str]) -> DataFrame:
        typed = frame.select(dimension.alias("dimension"), key.alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
        return typed.unpivot(["dimension", "key"], columns, "metric", "value").select(
            F.lit(section).alias("section"), "dimension", "key", "metric", "value", none.alias("note")
        )

    parts = [
        long(s, "slices", F.col("dimension"), F.col("value"), names),
        long(o, "overall", none, none, names),
        long(d, "disparities", F.col("dimension"), F.col("metric"), spread),
        v.select(F.lit("violations").alias("section"), "dimension", none.alias("key"), "metric",
                 F.col("range").alias("value"), F.col("severity").alias("note")),
        recommendations(v).select(F.lit("recommendations").alias("section"), none.alias("dimension"), F.col("priority").alias("key"),
                                  none.alias("metric"), F.lit(None).cast("double").alias("value"),
                                  F.concat_ws(": ", "issue", "suggestion").alias("note")),
    ]
    return reduce(DataFrame.unionByName, parts)
