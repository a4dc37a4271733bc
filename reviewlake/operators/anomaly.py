"""Anomaly reports in long form: (anomaly, subject, count, percentage, ids, detail).

`ids` lists the ten smallest row ids, found by a distributed top-k, joined by
commas. Every report is aggregates plus top-k; none sorts or collects a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.functions import distributed as ds
from reviewlake.operators import validation
from reviewlake.session import settled

SAMPLE_IDS = 10
Z_LIMIT = 3.0
SHORT_TEXT = 10
TEMPLATE_TEXT = validation.SHORT_PART
TEMPLATE_REPEATS = 5
TEMPLATE_EXAMPLES = 5
DOMINANT_SHARE = 0.8
IQR_FACTOR = 1.5
OLDEST_DATE = "1990-01-01"
ID = "review_id"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c != ID and t in NUMERIC_TYPES]


def _row(anomaly, subject, count, percentage=None, ids=None, detail=None) -> list[Column]:
    empty = {"percentage": "double", "ids": "string", "detail": "string"}
    given = {"percentage": percentage, "ids": ids, "detail": detail}
    return [
        anomaly.alias("anomaly"),
        subject.alias("subject"),
        count.alias("count"),
        *[(F.lit(None).cast(t) if given[c] is None else given[c]).alias(c) for c, t in empty.items()],
    ]


def first_ids(members: DataFrame, key: str) -> DataFrame:
    """Rows (key, ids): the ten smallest ids of each key as text.

    The rank limit is applied inside every map task before the shuffle, so at
    most ten rows per key and task are moved, however many rows a key has.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(ID))
    top = members.select(key, ID).withColumn("__r", rank).filter(F.col("__r") <= SAMPLE_IDS)
    ids = F.transform(F.array_sort(F.collect_list(ID)), lambda x: x.cast("string"))
    return top.groupBy(key).agg(F.array_join(ids, ",").alias("ids"))


def flagged(df: DataFrame, flags: list[tuple[str, str, Column]]) -> DataFrame:
    """Report rows for flags (anomaly, subject, condition); those without a hit are left out.

    All conditions are tested in one scan for the counts and one for the ids.
    """
    names = F.array(*[F.struct(F.lit(a).alias("anomaly"), F.lit(s).alias("subject")) for a, s, _ in flags])
    tests = F.array(*[F.when(c, F.lit(i)) for i, (_, _, c) in enumerate(flags)])
    hits = df.select(ID, F.explode(F.array_compact(tests)).alias("flag"))
    counts = hits.groupBy("flag").agg(F.count(F.lit(1)).alias("count"))
    name = F.element_at(names, F.col("flag") + 1)
    return counts.join(first_ids(hits, "flag"), "flag").select(
        *_row(name["anomaly"], name["subject"], F.col("count"), ids=F.col("ids"))
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Counts and first ids of identical rows and of rows with the same text.

    The digests are written once; counting and listing read 32 bytes per row.
    """
    digests = settled(df.select(
        ID,
        F.explode(F.array(
            F.struct(F.lit("exact").alias("kind"), validation.row_key(df).alias("key")),
            F.struct(F.lit("text").alias("kind"), validation.text_key(df).alias("key")),
        )).alias("d"),
    ).select(ID, "d.kind", "d.key"), "digests")
    groups = digests.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.groupBy("kind").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("count"))
    members = digests.join(groups.filter("n > 1").select("kind", "key"), ["kind", "key"], "left_semi")
    return counts.join(first_ids(members, "kind"), "kind", "left").select(
        *_row(F.lit("duplicates"), F.col("kind"), F.col("count"), ids=F.col("ids"))
    )


def _short_flags() -> list:
    return [("very_short_reviews", "text_length", F.col("text_length") < SHORT_TEXT)]


def short_texts(df: DataFrame) -> DataFrame:
    return flagged(df, _short_flags())


def templates(df: DataFrame) -> DataFrame:
    """The most frequent short texts that occur more than five times."""
    common = (
        df.filter(F.length("reviewText") < TEMPLATE_TEXT)
        .groupBy("reviewText")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > TEMPLATE_REPEATS)
        .orderBy(F.desc("count"), "reviewText")
        .limit(TEMPLATE_EXAMPLES)
    )
    return common.select(
        *_row(F.lit("repeated_templates"), F.lit("reviewText"), F.col("count"), detail=F.col("reviewText"))
    )


def _missing_flags(df: DataFrame) -> list:
    return [("missing", c, F.col(c).isNull()) for c in validation.data_columns(df)]


def _with_share(report: DataFrame, df: DataFrame) -> DataFrame:
    """Percentage of all rows, for the missing-value rows of a report."""
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.when(F.col("anomaly") == "missing", F.round(F.col("count") * 100.0 / total, 2))
    return report.withColumn("percentage", share)


def missing(df: DataFrame) -> DataFrame:
    """Columns with at least one null, with the first ids of their gaps."""
    return _with_share(flagged(df, _missing_flags(df)), df)


def _with_stats(df: DataFrame) -> DataFrame:
    """Add the mean and deviation of every numeric column, from one aggregate."""
    each = [
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in numeric_columns(df)
    ]
    return df.withColumn("__stats", df.agg(F.struct(*each).alias("s")).scalar())


def _z_flags(df: DataFrame, limit: float) -> list:
    def outlier(c: str) -> Column:
        s = F.col("__stats")[c]
        return (s["sd"] > 0) & (F.abs(F.col(c) - s["mean"]) > F.lit(limit) * s["sd"])

    return [("numeric_outliers", c, outlier(c)) for c in numeric_columns(df)]


def z_scores(df: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Rows further than `limit` population deviations from their column's mean."""
    return flagged(_with_stats(df), _z_flags(df, limit))


def iqr(df: DataFrame, factor: float = IQR_FACTOR) -> DataFrame:
    """Per numeric column: exact quartiles, fences and the rows outside them.

    The fences are one row per column, so they are broadcast to the counts.
    """
    counted = settled(ds.value_counts(df, numeric_columns(df)), "value-counts")
    q = ds.percentiles_of_counts(counted, [0.25, 0.75]).groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    spread = F.col("q3") - F.col("q1")
    fences = q.withColumn("low", F.col("q1") - factor * spread).withColumn("high", F.col("q3") + factor * spread)
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return counted.join(F.broadcast(fences), "column").groupBy(F.col("column").alias("subject")).agg(
        *[F.max(c).alias(c) for c in ("q1", "q3", "low", "high")],
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("count"),
    )


def _date_flags(as_of: str) -> list:
    d = F.col("reviewDate").try_cast("date")
    return [
        ("date_anomalies", "future_dates", d > F.lit(as_of).cast("date")),
        ("date_anomalies", "old_dates", d < F.lit(OLDEST_DATE).cast("date")),
    ]


def dates(df: DataFrame, as_of: str) -> DataFrame:
    return flagged(df, _date_flags(as_of))


def _rating_flags() -> list:
    r = F.col("reviewRating")
    return [("rating_anomalies", "invalid_ratings", (r < 1) | (r > 5))]


def invalid_ratings(df: DataFrame) -> DataFrame:
    return flagged(df, _rating_flags())


def dominance(df: DataFrame) -> DataFrame:
    """The rating that holds more than 80% of the rated rows, if one does."""
    counts = df.filter(F.col("reviewRating").isNotNull()).groupBy("reviewRating").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(
        F.max("n").alias("count"),
        F.sum("n").alias("total"),
        F.max_by("reviewRating", F.struct("n", -F.col("reviewRating"))).alias("rating"),
    )
    share = F.col("count") / F.col("total")
    return top.filter(share > DOMINANT_SHARE).select(
        *_row(
            F.lit("rating_anomalies"), F.lit("rating_imbalance"), F.col("count"),
            percentage=F.round(share * 100, 2), detail=F.col("rating").cast("int").cast("string"),
        )
    )


def anomaly_report(df: DataFrame, as_of: str) -> DataFrame:
    """All reports together over a feature table; every row flag shares the same scans."""
    flags = [
        *_z_flags(df, Z_LIMIT), *_short_flags(), *_missing_flags(df), *_date_flags(as_of), *_rating_flags(),
    ]
    row_flags = _with_share(flagged(_with_stats(df), flags), df)
    return reduce(DataFrame.unionByName, [row_flags, duplicates(df), templates(df), dominance(df)])
