"""Full triage: critical issues, label, sarcasm, override, aspects, reply.

One chain of projections over a frame with a predicted class and confidence;
nothing shuffles. A row without text fails alone and keeps its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import pinned
from reviewlake.functions.labels import class_label, polarity, rating_label
from reviewlake.functions.text import strings
from reviewlake.operators import aspects, critical, replies, sarcasm


def review_text(df: DataFrame) -> Column:
    """`reviewText`, else `text`: whichever columns the frame has."""
    present = [F.col(c) for c in ("reviewText", "text") if c in df.columns]
    return F.coalesce(*present)


def final_label(label: Column, sarcastic: Column, issue: Column) -> Column:
    """Sarcasm first, then any critical issue forces `terrible`."""
    return F.when(issue, "terrible").otherwise(sarcasm.corrected(label, sarcastic))


def add_issues(df: DataFrame) -> DataFrame:
    """Add the lower-cased text and the found categories, which callers filter on."""
    found = df.withColumn("text_lc", F.lower("reviewText")).withColumn("__found", critical.categories(F.col("text_lc")))
    return pinned(found, "categories", F.col("__found")).drop("__found")


def add_sentiment(df: DataFrame, prediction: str = "p") -> DataFrame:
    """Add the predicted label, the sarcasm verdict and the final label."""
    staged = df.withColumn("original_sentiment", class_label(F.col(prediction))).withColumn(
        "sarcasm_score", sarcasm.score(F.col("reviewText"), F.col("text_lc"))
    )
    sarcastic = sarcasm.is_sarcastic(F.col("sarcasm_score"))
    return staged.select(
        "*",
        sarcastic.alias("sarcasm_detected"),
        sarcasm.confidence(F.col("sarcasm_score")).alias("sarcasm_confidence"),
        sarcasm.corrected(F.col("original_sentiment"), sarcastic).alias("corrected_sentiment"),
        final_label(F.col("original_sentiment"), sarcastic, critical.has_issue(F.col("categories"))).alias("sentiment"),
    )


def analyse(df: DataFrame, prediction: str = "p") -> DataFrame:
    """All analysis columns for rows that have a text."""
    staged = add_sentiment(add_issues(df), prediction)
    return aspects.add_patterns(aspects.add_aspects(aspects.add_clauses(staged)), "sentiment")


def triage(df: DataFrame, prediction: str = "p", book: replies.ReplyBook = replies.DEFAULT_BOOK) -> DataFrame:
    """Analysis, reply and status per review."""
    text = review_text(df)
    analysed = analyse(df.withColumn("reviewText", text), prediction)
    replied = analysed.withColumn("generated_response", replies.routed(book))
    return replied.withColumn("status", F.when(F.col("reviewText").isNull(), "failed").otherwise("success"))


def flat(df: DataFrame) -> DataFrame:
    """The triage result with scalars and joined lists only; failed rows hold nulls."""
    ok = F.col("status") == "success"
    joined = {
        c: F.array_join(c, "|")
        for c in ("categories", "aspects_mentioned", "positive_aspects", "negative_aspects", "priority_aspects")
    }
    scalars = {
        "severity": critical.severity(F.col("categories")),
        "should_escalate": critical.escalate(F.col("categories")),
        **{
            c: F.col(c)
            for c in (
                "original_sentiment", "sarcasm_detected", "sarcasm_confidence", "corrected_sentiment",
                "sentiment", "confidence", "has_conflict", "dominant_aspect", "pattern", "mismatch",
                "aspect_overall", "generated_response",
            )
        },
    }
    return df.select(
        "review_id", "status", *[F.when(ok, v).alias(k) for k, v in {**joined, **scalars}.items()]
    )


RECORD_FACTS = ("placeName", "placeAddress", "provider", "authorName", "reviewRating", "reviewDate")


def record(df: DataFrame) -> DataFrame:
    """The whole result of a triaged frame, one row per review: its facts, status and error, whether a critical
    issue overrode the label, the matched keywords by category, and label and score of every aspect."""
    ok = F.col("status") == "success"
    found = F.filter(critical.issues(F.col("text_lc")), lambda i: F.size(i["matched_keywords"]) > 0)
    keywords = F.array_join(F.transform(found, lambda i: F.concat(i["category"], F.lit(": "), F.array_join(i["matched_keywords"], ", "))), "; ")
    wide = {f"{a}_{part}": F.get(F.col("aspects"), F.lit(i))[part] for i, a in enumerate(lx.ASPECTS) for part in ("sentiment", "score")}
    values = {
        "sentiment": F.col("sentiment"), "confidence": F.col("confidence"),
        "overridden_by_critical_issue": critical.has_issue(F.col("categories")) & (F.col("corrected_sentiment") != "terrible"),
        "matched_keywords": keywords, **wide, "generated_response": F.col("generated_response"),
    }
    return df.select(
        "review_id", *[c for c in RECORD_FACTS if c in df.columns], "status", F.when(~ok, "no review text").alias("error"),
        *[F.when(ok, v).alias(k) for k, v in values.items()],
    )


def expectations(df: DataFrame) -> DataFrame:
    """Found against expected labels per review: `expected_overall` and `expected_<aspect>` columns, null where nothing is
    expected. A review passes if its label is as expected; mentioned aspects are counted apart."""
    def seen(aspect: str) -> Column:
        return F.col(f"{aspect}_sentiment").isNotNull() & (F.col(f"{aspect}_sentiment") != "not_mentioned")

    expected = [a for a in lx.ASPECTS if f"expected_{a}" in df.columns]
    right = [seen(a) & (F.col(f"{a}_sentiment") == F.coalesce(F.col(f"expected_{a}"), F.col(f"{a}_sentiment"))) for a in expected]
    failed = F.array_compact(F.array(*[F.when(seen(a) & ~r, F.lit(a)) for a, r in zip(expected, right, strict=True)])) if expected else strings([])
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return df.select(
        "review_id", "sentiment", "expected_overall",
        F.coalesce(F.col("sentiment") == F.coalesce("expected_overall", "sentiment"), F.lit(False)).alias("passed"),
        total([seen(a) for a in expected]).alias("aspects_seen"), total(right).alias("aspects_right"), F.array_join(failed, "|").alias("aspects_failed"),
    )


def expectation_summary(checked: DataFrame) -> DataFrame:
    """One row: reviews, passed, failed and the rate in percent with one decimal."""
    return checked.agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.coalesce(F.avg(F.when(F.col("passed"), 100.0).otherwise(0.0)), F.lit(0.0)), 1).alias("success_rate"),
    )


def batch_score(df: DataFrame) -> DataFrame:
    """Label, confidence and reply per row; failed rows get `error`, 0 and ''."""
    ok = F.col("status") == "success"
    return df.select(
        "review_id",
        F.when(ok, F.col("sentiment")).otherwise("error").alias("sentiment"),
        F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(ok, F.col("generated_response")).otherwise("").alias("generated_response"),
    )


def agreement(df: DataFrame, rating: str = "reviewRating") -> DataFrame:
    """How often the label of the rating and the aspect-derived label have the same polarity."""
    same = polarity(rating_label(F.col(rating), "amazing")) == F.col("aspect_overall")
    with_aspects = df.filter(F.size("aspects_mentioned") > 0).select("review_id", same.alias("same"))
    examples = with_aspects.filter(~F.col("same")).select("review_id").orderBy("review_id").limit(3)
    ids = F.transform(F.array_sort(F.collect_list("review_id")), lambda x: x.cast("string"))
    return with_aspects.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.round(F.avg(F.when(F.col("same"), 100.0).otherwise(0.0)), 2).alias("agreement_rate"),
        F.count_if(~F.col("same")).alias("disagreements"),
    ).select("*", examples.agg(F.array_join(ids, ",")).scalar().alias("examples"))
