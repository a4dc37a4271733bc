"""Cleaning of raw string reviews. Each function is `DataFrame -> DataFrame`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions import text as tx
from reviewlake.functions.distributed import row_digest
from reviewlake.session import settled

RATING_MIN, RATING_MAX = 1, 5
MIN_TEXT, MAX_TEXT = 10, 5000


def require_columns(df: DataFrame, required: Sequence[str] = lx.REQUIRED_COLUMNS) -> DataFrame:
    """Return `df`, or raise naming the columns it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def drop_header_rows(df: DataFrame, columns: Sequence[str] = lx.REVIEW_COLUMNS) -> DataFrame:
    """Drop rows in which any column holds its own name (a header read as data)."""
    repeated = [F.coalesce(F.col(c).cast("string") == c, F.lit(False)) for c in columns if c in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, repeated))


def numeric(column: Column) -> Column:
    """Number in a text, else null."""
    return column.try_cast("double")


def coerce_rating(df: DataFrame) -> DataFrame:
    return df.withColumn("reviewRating", numeric(F.col("reviewRating")))


def keep_valid_ratings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reviewRating").between(RATING_MIN, RATING_MAX))


def rating_to_int(df: DataFrame) -> DataFrame:
    """Truncate: 4.5 becomes 4."""
    return df.withColumn("reviewRating", F.col("reviewRating").cast("int"))


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("reviewText", "reviewRating")) -> DataFrame:
    return df.dropna(subset=list(columns))


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with a numeric rating and a text, with the text's length."""
    typed = drop_incomplete(coerce_rating(df))
    return typed.withColumn("text_length", F.length("reviewText"))


def rating_text(rating: Column) -> Column:
    """The stock sentence for a rating; '' for any other value."""
    out = F.when(F.lit(False), F.lit(""))
    for value, sentence in lx.RATING_TEXTS.items():
        out = out.when(rating == value, sentence)
    return out.otherwise("")


def impute_text(df: DataFrame) -> DataFrame:
    filled = F.when(tx.is_blank(F.col("reviewText")), rating_text(F.col("reviewRating")))
    return df.withColumn("reviewText", filled.otherwise(F.col("reviewText")))


def coerce_date(df: DataFrame) -> DataFrame:
    return df.withColumn("reviewDate", F.col("reviewDate").try_cast("date"))


def clean_texts(df: DataFrame) -> DataFrame:
    return df.withColumn("reviewText", tx.clean_text(F.col("reviewText")))


def clean_reviews(df: DataFrame) -> DataFrame:
    """Strict cleaning: headers, ratings 1..5, stock texts, dates, text."""
    return (
        require_columns(df)
        .transform(drop_header_rows)
        .transform(coerce_rating)
        .transform(keep_valid_ratings)
        .transform(rating_to_int)
        .transform(impute_text)
        .transform(coerce_date)
        .transform(clean_texts)
    )


def clean_lenient(df: DataFrame) -> DataFrame:
    """Cleaning without header and range handling; null ratings are dropped."""
    return (
        require_columns(df)
        .transform(coerce_rating)
        .dropna(subset=["reviewRating"])
        .transform(rating_to_int)
        .transform(impute_text)
        .transform(coerce_date)
        .transform(clean_texts)
    )


def drop_exact_duplicates(df: DataFrame, columns: Sequence[str] = lx.REVIEW_COLUMNS) -> DataFrame:
    """One row per set of identical rows: the one with the smallest `review_id`.

    Identical rows are found by digest and id, 40 bytes a row. Only the ids of
    further copies are joined back, so texts move only if those are too many to
    broadcast. A frame without ids falls back on comparing whole rows.
    """
    if "review_id" not in df.columns:
        return df.select(*columns).dropDuplicates()
    digests = settled(df.select("review_id", row_digest(columns).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("review_id").alias("first")).filter("n > 1")
    copies = settled(digests.join(first, "digest").filter("review_id <> first").select("review_id"), "copies")
    return df.join(copies, "review_id", "left_anti").select(*columns)


def keep_text_lengths(df: DataFrame, shortest: int = MIN_TEXT, longest: int = MAX_TEXT) -> DataFrame:
    return df.filter(F.length("reviewText").between(shortest, longest))
