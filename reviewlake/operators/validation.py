"""Data-quality checks. Reports are long-form rows, one pass over the data each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import row_digest

EXPECTED_TYPES = {"reviewRating": "int", "reviewText": "string"}
MAX_EXACT_DUPLICATES = 5
ROW_KEY, TEXT_KEY = "__row", "__text"
SHORT_PART = 50  # characters of a text that a slim frame keeps


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row id, which the file does not carry."""
    return [c for c in df.columns if c not in ("review_id", ROW_KEY, TEXT_KEY)]


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; 0 for an empty whole."""
    return F.when(whole > 0, F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 2)).otherwise(0.0)


def check_types(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """Rows (column, expected, actual, valid) for the columns that are present."""
    expected = expected or EXPECTED_TYPES
    actual = dict(df.dtypes)
    facts = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("expected"), F.lit(actual[c]).alias("actual"),
            F.lit(actual[c] == t or (t == "int" and actual[c] == "bigint")).alias("valid"),
        )
        for c, t in expected.items()
        if c in actual
    ]
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.explode(F.array(*facts)).alias("f"), "n").select("f.*", F.col("n").alias("rows"))


def check_ratings(df: DataFrame) -> DataFrame:
    r = F.col("reviewRating")
    stats = df.agg(
        F.min(r).cast("double").alias("min"),
        F.max(r).cast("double").alias("max"),
        F.count_if((r < 1) | (r > 5)).alias("out_of_range_count"),
    )
    return stats.withColumn("valid", (F.col("min") >= 1) & (F.col("max") <= 5))


def check_lengths(df: DataFrame) -> DataFrame:
    n = F.col("text_length")
    return df.agg(
        F.min(n).cast("double").alias("min"),
        F.max(n).cast("double").alias("max"),
        F.round(F.avg(n), 6).alias("mean"),
        F.count_if(n == 0).alias("empty_count"),
    )


def row_key(df: DataFrame) -> Column:
    return F.col(ROW_KEY) if ROW_KEY in df.columns else row_digest(data_columns(df))


def text_key(df: DataFrame) -> Column:
    return F.col(TEXT_KEY) if TEXT_KEY in df.columns else row_digest(["reviewText"])


def slim(df: DataFrame) -> DataFrame:
    """The frame without its texts, for reports that are worth writing down.

    Digests of row and text are taken first; of the text the beginning stays,
    long enough to tell short texts apart and to see whether there is one.
    """
    keyed = df.select("*", row_digest(data_columns(df)).alias(ROW_KEY), row_digest(["reviewText"]).alias(TEXT_KEY))
    return keyed.withColumn("reviewText", F.substring("reviewText", 1, SHORT_PART))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, missing_count, missing_percentage, is_critical) from one aggregate."""
    columns = list(columns or data_columns(df))
    wide = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    long = wide.unpivot("__n", columns, "column", "missing_count")
    return long.select(
        "column",
        "missing_count",
        percent(F.col("missing_count"), F.col("__n")).alias("missing_percentage"),
        F.col("column").isin(*lx.CRITICAL_COLUMNS).alias("is_critical"),
    )


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows (kind, rows): members of same-text and of identical-row groups.

    Both kinds are counted in one pass. Groups are keyed by a digest, so texts
    do not travel, and hot groups of copies shrink to one partial count per
    task. Without texts their count is 0.
    """
    keys = [F.struct(F.lit("exact_duplicates").alias("kind"), row_key(df).alias("key"))]
    if "reviewText" in df.columns:
        keys.append(F.struct(F.lit("duplicate_texts").alias("kind"), text_key(df).alias("key")))
    groups = df.select(F.explode(F.array(*keys)).alias("d")).groupBy("d.kind", "d.key").agg(F.count(F.lit(1)).alias("n"))
    found = groups.agg(*[
        F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias(k)
        for k in ("exact_duplicates", "duplicate_texts")
    ])
    return found.unpivot([], ["exact_duplicates", "duplicate_texts"], "kind", "rows")


def gate(df: DataFrame) -> DataFrame:
    """One row (passed, exact_duplicates, issues): the decision of the checks.

    Issues are joined with `; `, duplicates first, then columns by name.
    """
    dup = duplicate_report(df).filter("kind = 'exact_duplicates'").select(
        F.lit(0).alias("place"),
        F.when(F.col("rows") > MAX_EXACT_DUPLICATES, F.lit("Exact duplicate rows found")).alias("issue"),
        F.col("rows").alias("dups"),
    )
    gaps = missing_report(df, [c for c in data_columns(df) if c in lx.CRITICAL_COLUMNS]).select(
        F.lit(1).alias("place"),
        F.when(
            F.col("missing_count") > 0,
            F.concat(F.lit("Critical column '"), F.col("column"), F.lit("' has missing values")),
        ).alias("issue"),
        F.lit(0).cast("long").alias("dups"),
    )
    found = F.array_sort(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("place", "issue"))))
    return dup.unionByName(gaps).agg(
        (F.count("issue") == 0).alias("passed"),
        F.sum("dups").alias("exact_duplicates"),
        F.array_join(F.transform(found, lambda x: x["issue"]), "; ").alias("issues"),
    )
