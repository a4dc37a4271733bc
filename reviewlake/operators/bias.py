"""Rating bias of the data, as small aggregate tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.distributed import corrected_skewness
from reviewlake.session import settled

POSITIVE_SHARE = 0.7
NEGATIVE_SHARE = 0.5
SHORT_TEXT = 20
LONG_QUANTILE = 0.9
COLUMNS = ("reviewRating", "text_length", "sentiment", "placeName", "reviewDate")  # all that the combined report reads


def r6(column: Column) -> Column:
    """Six decimals: means depend on the order of addition beyond that."""
    return F.round(column, 6)


def distribution(df: DataFrame) -> DataFrame:
    """Share of each rating among the rated rows."""
    counts = df.filter(F.col("reviewRating").isNotNull()).groupBy("reviewRating").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("reviewRating", "count", r6(F.col("count") / total).alias("share"))


def moments(df: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, bias-corrected skew. Ratings have few values,
    so the exact median keeps a handful of counts."""
    r = F.col("reviewRating").cast("double")
    return df.agg(
        r6(F.avg(r)).alias("mean_rating"),
        F.median(r).alias("median_rating"),
        r6(F.stddev_samp(r)).alias("std_rating"),
        r6(corrected_skewness(r)).alias("skewness"),
    )


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ratios(df: DataFrame) -> DataFrame:
    """Shares over all rows, unrated ones included."""
    r = F.col("reviewRating")
    return df.agg(
        r6(_share(r >= 4)).alias("positive_ratio"),
        r6(_share(r <= 2)).alias("negative_ratio"),
        r6(_share(r == 3)).alias("neutral_ratio"),
    )


def verdict(df: DataFrame) -> DataFrame:
    r = F.col("reviewRating")
    shares = df.agg(_share(r >= 4).alias("p"), _share(r <= 2).alias("n"))
    return shares.select(_verdict().alias("bias"))


def _verdict() -> Column:
    return F.when(F.col("p") > POSITIVE_SHARE, "positive").when(F.col("n") > NEGATIVE_SHARE, "negative").otherwise("none")


def by_category(df: DataFrame, column: str) -> DataFrame:
    """Count, percentage of all rows, mean and sample deviation per category."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("category"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            r6(F.avg("reviewRating")).alias("avg_rating"),
            r6(F.stddev_samp("reviewRating")).alias("rating_std"),
        )
        .select(
            F.lit(column).alias("dimension"), "category", "count",
            r6(F.col("count") * 100.0 / total).alias("percentage"), "avg_rating", "rating_std",
        )
    )


def imbalance(df: DataFrame, column: str) -> DataFrame:
    """Largest over smallest category, both named (ties: smallest name), and the null rows."""
    return _imbalance_of(df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n")), column)


def _imbalance_of(counts: DataFrame, column: str) -> DataFrame:
    named = F.col("category").isNotNull()
    return counts.agg(
        F.min(F.when(named, F.struct((-F.col("n")).alias("n"), "category"))).alias("most"),
        F.min(F.when(named, F.struct("n", "category"))).alias("least"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("null_count"),
    ).select(
        F.lit(column).alias("dimension"),
        r6(-F.col("most.n") / F.col("least.n")).alias("imbalance_ratio"),
        F.col("most.category").alias("most_common"),
        F.col("least.category").alias("least_common"),
        "null_count",
    )


def monthly(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and count per month; rows without a valid date are left out."""
    month = F.date_trunc("MONTH", F.col("reviewDate").try_cast("date")).cast("date")
    return (
        df.select(month.alias("month"), "reviewRating")
        .filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            r6(F.avg("reviewRating")).alias("mean_rating"),
            r6(F.stddev_samp("reviewRating")).alias("std_rating"),
            F.count("reviewRating").alias("count"),
        )
    )


def by_length(df: DataFrame) -> DataFrame:
    """Short (< 20) and long (> 90th percentile) texts: count and mean rating.

    Lengths are counted first; the exact percentile then weighs one row per
    distinct length, which is bounded by the longest text.
    """
    lengths = df.filter(F.col("text_length").isNotNull()).groupBy("text_length").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("reviewRating").alias("rated"),
        F.sum("reviewRating").alias("stars"),
    )
    return _lengths_report(lengths)


def _lengths_report(lengths: DataFrame) -> DataFrame:
    """lengths: (text_length, n, rated, stars), one row for each length."""
    cut = lengths.agg(F.percentile("text_length", F.lit(LONG_QUANTILE), F.col("n"))).scalar()
    short = F.col("text_length") < SHORT_TEXT
    long = F.col("text_length") > cut

    def mean_of(condition: Column) -> Column:
        rated = F.sum(F.when(condition, F.col("rated")))
        return r6(F.sum(F.when(condition, F.col("stars"))) / F.nullif(rated, F.lit(0)))

    def rows_of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return lengths.agg(
        rows_of(short).alias("short_reviews_count"),
        rows_of(long).alias("long_reviews_count"),
        mean_of(short).alias("avg_rating_short"),
        mean_of(long).alias("avg_rating_long"),
    )


# --- the cube: one pass over the rows, everything else from counts -------------------------------------------

CUBE = "dimension string, key string, rating double, n bigint"


def cube(df: DataFrame) -> DataFrame:
    """Rows (dimension, key, rating, n): how often each rating occurs over all rows, per sentiment, place, month and text length.

    One scan; every task sends its own counts only. Cubes add up: the cube of two loads is the sum of theirs.
    """
    def mark(dimension: str, key: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), key.cast("string").alias("key"))

    marks = [mark("all", F.lit(None)), *[mark(c, F.col(c)) for c in CATEGORIES if c in df.columns]]
    marks.append(F.when(F.col("text_length").isNotNull(), mark("text_length", F.col("text_length"))))
    if "reviewDate" in df.columns:
        month = F.date_format(F.col("reviewDate").try_cast("date"), "yyyy-MM")
        marks.append(F.when(month.isNotNull(), mark("month", month)))
    # The outer form is not turned into a "not empty" filter, which would derive the columns twice; "all" is always there.
    each = df.select(F.col("reviewRating").cast("double").alias("rating"), F.explode_outer(F.array_compact(F.array(*marks))).alias("m"))
    return each.groupBy("m.dimension", "m.key", "rating").agg(F.count(F.lit(1)).alias("n"))


def merged(cubes: DataFrame) -> DataFrame:
    """One cube from the rows of several."""
    return cubes.groupBy("dimension", "key", "rating").agg(F.sum("n").alias("n"))


def save_cube(df: DataFrame, store: str, load: str) -> None:
    """Keep the cube of one load; a load written again replaces itself."""
    cube(df).coalesce(1).write.mode("overwrite").parquet(f"{store}/load={load}")


def stored_report(spark: SparkSession, store: str) -> DataFrame:
    """The report over all loads kept in a store; their rows are not read again."""
    return cube_report(settled(merged(spark.read.schema(CUBE).parquet(store)), "cube"))


def _sums() -> list[Column]:
    """Rows, rated rows, and first and second power sums of the rating."""
    r, n = F.col("rating"), F.col("n")
    return [
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(r.isNotNull(), n)), F.lit(0)).alias("rated"),
        F.sum(r * n).alias("s1"), F.sum(r * r * n).alias("s2"),
    ]


def _mean_and_deviation() -> tuple[Column, Column]:
    rated = F.nullif(F.col("rated"), F.lit(0))
    mean = F.col("s1") / rated
    variance = F.greatest((F.col("s2") - F.col("s1") * mean) / F.nullif(rated - 1, F.lit(0)), F.lit(0.0))
    return r6(mean), r6(F.when(F.col("rated") > 1, F.sqrt(variance)))


def _cube_moments(everything: DataFrame) -> DataFrame:
    r, n = F.col("rating"), F.col("n")
    rated = everything.filter(r.isNotNull())
    mean = rated.agg(F.sum(r * n) / F.sum(n)).scalar()
    apart = r - mean
    sums = rated.agg(
        F.sum("n").cast("double").alias("n"), F.sum(r * n).alias("s1"), F.percentile(r, F.lit(0.5), n).alias("median_rating"),
        F.sum(apart * apart * n).alias("m2"), F.sum(apart * apart * apart * n).alias("m3"),
    )
    c, m2, m3 = F.col("n"), F.col("m2"), F.col("m3")
    skew = F.sqrt(c * (c - 1)) / F.nullif(c - 2, F.lit(0.0)) * (m3 / c) / F.nullif(F.pow(m2 / c, F.lit(1.5)), F.lit(0.0))
    return sums.select(
        r6(F.col("s1") / c).alias("mean_rating"), "median_rating", r6(F.when(c > 1, F.sqrt(m2 / F.nullif(c - 1, F.lit(0.0))))).alias("std_rating"),
        r6(F.when((c > 2) & (m2 > 0), skew)).alias("skewness"),
    )


CATEGORIES = ("sentiment", "placeName")


def cube_report(counts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """The rows (section, key, metric, value) of `bias_report`, from a cube."""
    def of(dimension: str) -> DataFrame:
        return counts.filter(F.col("dimension") == dimension)

    everything, all_rows = of("all"), F.lit("all")
    r, n = F.col("rating"), F.col("n")
    rated = everything.filter(r.isNotNull()).select(r.alias("reviewRating"), n.alias("count"))
    total = everything.agg(F.sum("n")).scalar()
    shares = rated.select("reviewRating", "count", r6(F.col("count") / rated.agg(F.sum("count")).scalar()).alias("share"))

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)) / F.sum("n")

    mean, deviation = _mean_and_deviation()
    lengths = of("text_length").groupBy(F.col("key").cast("long").alias("text_length")).agg(*_sums())
    lengths = lengths.select("text_length", F.col("rows").alias("n"), "rated", F.col("s1").alias("stars"))
    parts = [
        _long("rating_distribution", shares, F.col("reviewRating").cast("int").cast("string"), ["count", "share"]),
        _long("rating_moments", _cube_moments(everything), all_rows, ["mean_rating", "median_rating", "std_rating", "skewness"]),
        _long("rating_ratios", everything.agg(r6(share(r >= 4)).alias("positive_ratio"), r6(share(r <= 2)).alias("negative_ratio"), r6(share(r == 3)).alias("neutral_ratio")),
              all_rows, ["positive_ratio", "negative_ratio", "neutral_ratio"]),
        _long("text_length", _lengths_report(lengths), all_rows, ["short_reviews_count", "long_reviews_count", "avg_rating_short", "avg_rating_long"]),
    ]
    for column in categories:
        groups = of(column).groupBy(F.col("key").alias("category")).agg(*_sums())
        named = groups.filter(F.col("category").isNotNull()).select(
            "category", F.col("rows").alias("count"), r6(F.col("rows") * 100.0 / total).alias("percentage"), mean.alias("avg_rating"), deviation.alias("rating_std")
        )
        parts.append(_long(column, named, F.col("category"), ["count", "percentage", "avg_rating", "rating_std"]))
        ratio = _imbalance_of(groups.select("category", F.col("rows").alias("n")), column)
        parts.append(_long(f"{column}_imbalance", ratio, all_rows, ["imbalance_ratio", "null_count"]))
    months = of("month").groupBy("key").agg(*_sums()).select("key", mean.alias("mean_rating"), deviation.alias("std_rating"), F.col("rated").alias("count"))
    parts.append(_long("monthly_trend", months, F.col("key"), ["mean_rating", "std_rating", "count"]))
    verdict_row = everything.agg(share(r >= 4).alias("p"), share(r <= 2).alias("n")).select(
        F.lit("verdict").alias("section"), _verdict().alias("key"), F.lit("bias").alias("metric"), F.lit(1.0).alias("value")
    )
    return reduce(DataFrame.unionByName, [*parts, verdict_row])


def _long(section: str, df: DataFrame, key: Column, metrics: list[str]) -> DataFrame:
    values = df.select(key.alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return values.unpivot("key", metrics, "metric", "value").select(
        F.lit(section).alias("section"), "key", "metric", "value"
    )


def bias_report(df: DataFrame) -> DataFrame:
    """All of the above as rows (section, key, metric, value), from one scan; trend only with a date column."""
    return cube_report(settled(cube(df), "cube"), [c for c in CATEGORIES if c in df.columns])
