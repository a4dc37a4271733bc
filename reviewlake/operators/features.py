"""Derived columns of cleaned reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.labels import rating_label
from reviewlake.session import settled

NULL_TEXT_LENGTH = 3  # fixed value: a missing text read as the word "nan"


def text_length(text: Column, pandas_compat: bool = False) -> Column:
    """Characters of the text; a null text gives null, or 3 with `pandas_compat`."""
    n = F.length(text)
    return F.coalesce(n, F.lit(NULL_TEXT_LENGTH)) if pandas_compat else n


def add_text_length(df: DataFrame, pandas_compat: bool = False) -> DataFrame:
    return df.withColumn("text_length", text_length(F.col("reviewText"), pandas_compat))


def add_label(df: DataFrame, scheme: str = "excellent") -> DataFrame:
    return df.withColumn("sentiment", rating_label(F.col("reviewRating"), scheme))


def add_place_average(df: DataFrame) -> DataFrame:
    """Mean rating of the row's place; null for rows without a place.

    Means are aggregated first (partial sums before the shuffle) and written
    out, so the planner knows how small they are before it plans the join: it
    broadcasts them under its own limit, and no row of the large side moves.
    Beyond the limit adaptive execution splits the partition of a hot place.
    """
    for column in ("placeName", "reviewRating"):
        if column not in df.columns:
            raise ValueError(f"required columns are missing: {column}")
    means = (
        df.filter(F.col("placeName").isNotNull())
        .groupBy("placeName")
        .agg(F.avg("reviewRating").alias("restaurant_avg_rating"))
    )
    return df.join(settled(means, "place-means"), "placeName", "left").select(*df.columns, "restaurant_avg_rating")


def create_features(df: DataFrame, pandas_compat: bool = False) -> DataFrame:
    return add_place_average(add_label(add_text_length(df, pandas_compat)))
