"""Reviews derived from the keyed tables and the documents.

One review per order (text from phrase tables, chosen by arithmetic on the
key, with known defects) and one per document (its whole text). `raw_reviews`
is all strings, as read from a file; `reviews` is typed and free of defects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.text import strings
from reviewlake.sources import phrases as ph
from reviewlake.sources.tables import table

COPY_OFFSET = 1_000_000_000
DOCUMENT_OFFSET = 2_000_000_000


def _pick(options, index: Column) -> Column:
    return F.element_at(strings(options), (F.pmod(index, F.lit(len(options))) + 1).cast("int"))


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def _rating(k: Column) -> Column:
    return (
        F.when(k < 650, 5).when(k < 786, 4).when(k < 852, 3).when(k < 882, 2).otherwise(1)
    ).cast("int")


def _order_text(key: Column, rating: Column) -> Column:
    opener = F.coalesce(
        *[F.when(rating == r, _pick(ph.OPENERS[r], _div(key, 3))) for r in sorted(ph.OPENERS)]
    )
    return F.concat(
        opener, F.lit(" "), _pick(ph.FIRST_CLAUSES, key * 31 + 7),
        _pick(ph.CONNECTORS, _div(key, 5)), _pick(ph.SECOND_CLAUSES, key * 17 + 3),
        F.lit("."), _pick(ph.TAILS, _div(key, 7)),
    )


def _order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Defect-free reviews of the orders; `id` is the order key, `k` drives ratings."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    id_ = F.col("o_orderkey")
    keyed = joined.withColumn("k", F.pmod(id_ * 7919 + F.col("o_custkey") * 104729, F.lit(1000)))
    rated = keyed.withColumn("rating", _rating(F.col("k")))
    return rated.select(
        id_.alias("id"),
        "k",
        F.col("n_name").alias("placeName"),
        F.col("r_name").alias("placeAddress"),
        _pick(ph.PROVIDERS, id_).alias("provider"),
        _order_text(id_, F.col("rating")).alias("reviewText"),
        F.to_date("o_orderdate").alias("reviewDate"),
        F.col("rating").alias("reviewRating"),
        F.col("c_name").alias("authorName"),
    )


def _document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    keyed = documents.withColumn(
        "k", F.pmod(doc * 7919 + F.col("n_chars") * 104729, F.lit(1000))
    )
    return keyed.select(
        (doc + DOCUMENT_OFFSET).alias("id"),
        "k",
        F.col("source").alias("placeName"),
        F.col("lang").alias("placeAddress"),
        _pick(ph.PROVIDERS, doc).alias("provider"),
        F.col("text").alias("reviewText"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(doc * 37, F.lit(2400)).cast("int")).alias("reviewDate"),
        _rating(F.col("k")).alias("reviewRating"),
        F.concat(F.lit("reader "), F.pmod(doc, F.lit(997)).cast("string")).alias("authorName"),
    )


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return _order_reviews(spark, folder).unionByName(_document_reviews(spark, folder))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Typed reviews without defects."""
    return _base(spark, folder).select(F.col("id").alias("review_id"), *lx.REVIEW_COLUMNS)


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """String reviews with the defects a file scan meets."""
    i = F.col("id")
    order_row = i < COPY_OFFSET

    def every(n: int, rest: int = 0) -> Column:
        return order_row & (F.pmod(i, F.lit(n)) == rest)

    base = _base(spark, folder)
    bad = base.select(
        "id",
        F.when(every(307, 1), None).otherwise(F.col("placeName")).alias("placeName"),
        "placeAddress",
        "provider",
        F.when(every(101), None)
        .when(every(103), F.lit("   "))
        .when(every(59), F.lit("ok"))
        .when(
            every(53),
            F.concat("reviewText", F.lit(" <b>Look</b> at http://example.com/r/"), i.cast("string")),
        )
        .otherwise(F.col("reviewText"))
        .alias("reviewText"),
        F.when(every(307), F.lit("not a date"))
        .when(every(311), F.lit("1985-06-01"))
        .when(every(313), F.lit("2099-01-01"))
        .otherwise(F.col("reviewDate").cast("string"))
        .alias("reviewDate"),
        F.when(order_row & (F.pmod(F.col("k"), F.lit(97)) == 0), None)
        .when(every(211), F.lit("9"))
        .when(every(223), F.lit("bad"))
        .when(every(227), F.lit("4.5"))
        .otherwise(F.col("reviewRating").cast("string"))
        .alias("reviewRating"),
        "authorName",
    )
    with_headers = bad.select(
        "id",
        *[F.when(every(509), F.lit(c)).otherwise(F.col(c)).alias(c) for c in lx.REVIEW_COLUMNS],
    )
    copies = F.when(every(401), F.array(F.lit(0), F.lit(COPY_OFFSET))).otherwise(F.array(F.lit(0)))
    return with_headers.select("*", F.explode(copies).alias("__c")).select(
        (i + F.col("__c")).alias("review_id"), *lx.REVIEW_COLUMNS
    )


def scored_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Typed reviews with a fixed rating prediction, its confidence and class scores.

    Stands in for the output of a fitted model where results must be exact.
    """
    k, i, y = F.col("k"), F.col("id"), F.col("reviewRating")
    step = F.pmod(i, F.lit(7))
    p = F.when(step == 0, y - 1).when(step == 1, y + 1).otherwise(y)
    base = _base(spark, folder).withColumn("p", F.greatest(F.lit(1), F.least(F.lit(5), p)))
    return base.select(
        i.alias("review_id"),
        *lx.REVIEW_COLUMNS,
        y.alias("y"),
        "p",
        ((F.lit(400) + F.pmod(k, F.lit(600))) / F.lit(1000.0)).alias("confidence"),
    )


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming reviews with a predicted rating; every 101st order has no text."""
    missing = (F.col("review_id") < COPY_OFFSET) & (F.pmod("review_id", F.lit(101)) == 0)
    return scored_reviews(spark, folder).withColumn(
        "reviewText", F.when(~missing, F.col("reviewText"))
    )


def conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reviewText"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated_response")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.lit(3_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
        "reviewText",
        "generated_response",
        F.element_at(strings(lx.LABELS_AMAZING), (F.pmod("conv_id", F.lit(5)) + 1).cast("int")).alias("sentiment"),
    )
