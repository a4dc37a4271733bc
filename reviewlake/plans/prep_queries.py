"""Registered queries: sources, cleaning, features, validation, anomalies, bias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as tx
from reviewlake.functions.labels import class_label
from reviewlake.operators import anomaly, bias, cleaning, features, validation
from reviewlake.session import scratch_dir, settled
from reviewlake.sources import readers, review_view, sinks
from reviewlake.sources.tables import table

AS_OF = "2002-01-01"
RATED = ["review_id", "reviewRating"]


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return review_view.raw_reviews(spark, folder)


def _headless(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_header_rows(_raw(spark, folder))


def clean_frame(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_reviews(_raw(spark, folder))


def feature_frame(spark: SparkSession, folder: str) -> DataFrame:
    return features.create_features(clean_frame(spark, folder))


def feature_store(spark: SparkSession, folder: str, pick=validation.slim) -> DataFrame:
    """What a report needs of the feature table, never whole texts, written once because it is read several times."""
    return settled(pick(feature_frame(spark, folder)), "features")


def typed_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Typed but uncleaned rows, so that gaps and bad values are still there."""
    typed = _headless(spark, folder).transform(cleaning.coerce_rating).transform(cleaning.rating_to_int)
    return features.add_text_length(typed.transform(cleaning.coerce_date))


def slim_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The typed rows without their texts, written once: counts, ids and totals each read them."""
    return settled(validation.slim(typed_frame(spark, folder)), "typed")


# --- sources ---------------------------------------------------------------

def scan_reviews(spark, folder):
    """Through CSV files whose quoted texts hold line breaks, read by byte ranges."""
    path = scratch_dir(spark, "scan")
    raw = _raw(spark, folder)
    sinks.write_csv(raw, path)
    return readers.read_reviews_csv(spark, path, raw.columns, multi_line=True).withColumn("review_id", F.col("review_id").cast("long"))


def required_columns(spark, folder):
    return readers.column_presence(_raw(spark, folder))


def ingest_profile(spark, folder):
    return readers.ingest_profile(_raw(spark, folder))


def json_source(spark, folder):
    """Through files of one JSON array each, read by byte ranges."""
    path = scratch_dir(spark, "json")
    raw = _raw(spark, folder)
    sinks.write_json_array(raw, path)
    return readers.read_reviews_json(spark, path, raw.columns, array_file=True).withColumn("review_id", F.col("review_id").cast("long"))


def review_pages(spark, folder, per_page: int = 20):
    """Stored pages of at most `per_page` reviews each, one JSON text per page."""
    r = review_view.reviews(spark, folder)
    odd = F.pmod("review_id", F.lit(3)) == 0
    item = F.struct(
        "review_id",
        F.struct(F.col("authorName").alias("name")).alias("user"),
        F.col("reviewRating").cast("double").alias("rating"),
        F.date_format("reviewDate", "yyyy-MM-dd").alias("iso_date"),
        F.when(odd, F.lit("")).otherwise(F.col("reviewText")).alias("snippet"),
        F.col("reviewText").alias("text"),
    )
    page = F.floor(F.col("review_id") / per_page).cast("long")
    grouped = r.groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(item)).alias("reviews"))
    return grouped.select("page_id", F.to_json(F.struct("reviews")).alias("page"))


def review_pages_flatten(spark, folder):
    return readers.flatten_pages(review_pages(spark, folder))


def csv_roundtrip(spark, folder):
    path = scratch_dir(spark, "csv")
    clean = clean_frame(spark, folder)
    sinks.write_csv(clean, path, escape_breaks=True)
    back = readers.read_reviews_csv(spark, path, clean.columns, multi_line=False, escaped_breaks=True)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in clean.dtypes])


def report_json(spark, folder):
    path = scratch_dir(spark, "report")
    report = validation.missing_report(typed_frame(spark, folder))
    sinks.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


# --- cleaning --------------------------------------------------------------

def drop_header_rows(spark, folder):
    return _headless(spark, folder)


def numeric_coerce(spark, folder):
    return cleaning.coerce_rating(_raw(spark, folder)).select(*RATED)


def rating_range(spark, folder):
    return cleaning.keep_valid_ratings(cleaning.coerce_rating(_raw(spark, folder))).select(*RATED)


def rating_int(spark, folder):
    return cleaning.rating_to_int(cleaning.coerce_rating(_raw(spark, folder))).select(*RATED)


def training_rows(spark, folder):
    return cleaning.training_rows(_raw(spark, folder)).select(*RATED, "text_length")


def impute_text(spark, folder):
    return cleaning.impute_text(cleaning.coerce_rating(_raw(spark, folder))).select("review_id", "reviewText")


def clean_text(spark, folder):
    """Every text there is: reviews (documents included), page markup, conversations."""
    pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    turns = table(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    raw = _raw(spark, folder).select(F.lit("review").alias("kind"), F.col("review_id").alias("id"), F.col("reviewText").alias("text"))
    texts = raw.unionByName(pages).unionByName(turns)
    return texts.select("kind", "id", tx.clean_text(F.col("text")).alias("clean"))


def clean_dates(spark, folder):
    return cleaning.coerce_date(_raw(spark, folder)).select("review_id", "reviewDate")


def clean_lenient(spark, folder):
    return cleaning.clean_lenient(_raw(spark, folder))


def dedup_exact(spark, folder):
    return cleaning.drop_exact_duplicates(_raw(spark, folder))


def length_bounds(spark, folder):
    return cleaning.keep_text_lengths(_raw(spark, folder)).select("review_id", F.length("reviewText").alias("n_chars"))


# --- features --------------------------------------------------------------

def text_length(spark, folder):
    t = F.col("reviewText")
    return _raw(spark, folder).select(
        "review_id", features.text_length(t).alias("text_length"),
        features.text_length(t, pandas_compat=True).alias("text_length_compat"),
    )


def rating_label(spark, folder):
    return features.add_label(typed_frame(spark, folder)).select(*RATED, "sentiment")


def restaurant_avg(spark, folder):
    df = features.add_place_average(clean_frame(spark, folder))
    return df.select("review_id", "placeName", bias.r6(F.col("restaurant_avg_rating")).alias("restaurant_avg_rating"))


def feature_table(spark, folder):
    df = feature_frame(spark, folder)
    return df.withColumn("restaurant_avg_rating", bias.r6(F.col("restaurant_avg_rating")))


def rating_to_label5(spark, folder):
    scored = review_view.scored_reviews(spark, folder)
    shifted = F.col("p") + F.pmod("review_id", F.lit(5)).cast("int") - 2
    return scored.select("review_id", shifted.alias("prediction"), class_label(shifted).alias("label"))


# --- validation ------------------------------------------------------------

def type_check(spark, folder):
    return validation.check_types(feature_frame(spark, folder))


def rating_checks(spark, folder):
    return validation.check_ratings(typed_frame(spark, folder))


def length_checks(spark, folder):
    return validation.check_lengths(typed_frame(spark, folder))


def missing_report(spark, folder):
    return validation.missing_report(typed_frame(spark, folder))


def duplicate_report(spark, folder):
    return validation.duplicate_report(typed_frame(spark, folder))


def validation_gate(spark, folder):
    return validation.gate(feature_store(spark, folder))


# --- anomalies -------------------------------------------------------------

def anom_duplicates(spark, folder):
    return anomaly.duplicates(typed_frame(spark, folder))


def anom_short(spark, folder):
    return anomaly.short_texts(slim_typed(spark, folder))


def anom_templates(spark, folder):
    return anomaly.templates(typed_frame(spark, folder))


def anom_missing(spark, folder):
    return anomaly.missing(slim_typed(spark, folder))


def anom_zscore(spark, folder):
    return anomaly.z_scores(feature_store(spark, folder, lambda df: df.select("review_id", *anomaly.numeric_columns(df))))


def anom_dates(spark, folder):
    return anomaly.dates(slim_typed(spark, folder), AS_OF)


def anom_ratings(spark, folder):
    return anomaly.invalid_ratings(slim_typed(spark, folder))


def anom_dominance(spark, folder):
    """Over the review ratings and over the 0/1 toxicity marks of the labels."""
    marks = table(spark, folder, "labels").select(F.col("toxic").alias("reviewRating"))
    return anomaly.dominance(typed_frame(spark, folder)).unionByName(anomaly.dominance(marks))


def anomaly_report(spark, folder):
    return anomaly.anomaly_report(slim_typed(spark, folder), AS_OF)


def anom_iqr(spark, folder):
    df = anomaly.iqr(feature_frame(spark, folder))
    return df.select("subject", *[bias.r6(F.col(c)).alias(c) for c in ("q1", "q3", "low", "high")], "count")


# --- bias ------------------------------------------------------------------

def rating_distribution(spark, folder):
    return bias.distribution(typed_frame(spark, folder))


def rating_moments(spark, folder):
    return bias.moments(clean_frame(spark, folder))


def rating_ratios(spark, folder):
    return bias.ratios(typed_frame(spark, folder))


def rating_bias_verdict(spark, folder):
    return bias.verdict(clean_frame(spark, folder))


def category_bias(spark, folder):
    df = settled(features.add_label(clean_frame(spark, folder)).select("sentiment", "placeName", "reviewRating"), "labelled")
    return bias.by_category(df, "sentiment").unionByName(bias.by_category(df, "placeName"))


def category_imbalance(spark, folder):
    df = settled(features.add_label(clean_frame(spark, folder)).select("sentiment", "placeName"), "labelled")
    return bias.imbalance(df, "sentiment").unionByName(bias.imbalance(df, "placeName"))


def monthly_trend(spark, folder):
    return bias.monthly(clean_frame(spark, folder))


def length_bias(spark, folder):
    df = features.add_text_length(clean_frame(spark, folder)).select("text_length", "reviewRating")
    return bias.by_length(settled(df, "lengths"))


def bias_report(spark, folder):
    return bias.bias_report(feature_frame(spark, folder).select(*bias.COLUMNS))


QUERIES = {
    f.__name__: f
    for f in (
        scan_reviews, required_columns, ingest_profile, json_source, review_pages_flatten,
        csv_roundtrip, report_json, drop_header_rows, numeric_coerce, rating_range, rating_int,
        training_rows, impute_text, clean_text, clean_dates, clean_lenient, dedup_exact,
        length_bounds, text_length, rating_label, restaurant_avg, rating_to_label5, type_check,
        rating_checks, length_checks, missing_report, duplicate_report, validation_gate,
        anom_duplicates, anom_short, anom_templates, anom_missing, anom_zscore, anom_dates,
        anom_ratings, anom_dominance, anomaly_report, anom_iqr, rating_distribution,
        rating_moments, rating_ratios, rating_bias_verdict, category_bias, category_imbalance,
        monthly_trend, length_bias, bias_report,
    )
}
QUERIES["clean_reviews"] = clean_frame
QUERIES["features"] = feature_table
