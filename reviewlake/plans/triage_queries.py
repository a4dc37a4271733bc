"""Registered queries: triage, replies, reply quality, run aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import once_per
from reviewlake.functions.labels import rating_label
from reviewlake.operators import aspects, critical, replies, reply_quality, runs, sarcasm, triage
from reviewlake.session import settled
from reviewlake.sources import review_view
from reviewlake.sources.tables import table

ID = "review_id"


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


def _with_issues(spark: SparkSession, folder: str) -> DataFrame:
    return triage.add_issues(review_view.scored_reviews(spark, folder))


def _with_aspects(spark: SparkSession, folder: str) -> DataFrame:
    scored = review_view.scored_reviews(spark, folder).select(ID, "reviewText", "reviewRating", "placeName")
    return aspects.add_aspects(aspects.add_clauses(scored))


def _analysed(spark: SparkSession, folder: str) -> DataFrame:
    return triage.analyse(review_view.scored_reviews(spark, folder))


def _triaged(spark: SparkSession, folder: str) -> DataFrame:
    return triage.triage(review_view.inbox(spark, folder))


def reply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Triaged reviews with their replies, and the turns of the conversations."""
    ours = _triaged(spark, folder).select(ID, "reviewText", "generated_response", "sentiment")
    return ours.unionByName(review_view.conversation_pairs(spark, folder))


def _scored_pairs(spark: SparkSession, folder: str, score=reply_quality.score_replies) -> DataFrame:
    """`reply_pairs` with their grades. Reply and grade of a review depend on its text and prediction alone, so each distinct
    pair of these is triaged and graded once."""
    ours = review_view.inbox(spark, folder).select(ID, "reviewText", "p")

    def graded(texts: DataFrame) -> DataFrame:
        return score(triage.triage(texts).select("reviewText", "p", "generated_response", "sentiment"))

    graded_once = once_per(ours, "reviewText", ["p"], graded, "graded").drop("p")
    return graded_once.unionByName(score(review_view.conversation_pairs(spark, folder)))


# --- triage ----------------------------------------------------------------

def critical_keywords(spark, folder):
    found = _with_issues(spark, folder).select(ID, F.explode_outer(critical.issues(F.col("text_lc"))).alias("i"))
    return found.filter("i IS NOT NULL").select(
        ID, "i.category", F.array_join("i.matched_keywords", "|").alias("matched_keywords"), "i.severity", "i.action"
    )


def critical_severity(spark, folder):
    return _with_issues(spark, folder).select(ID, critical.severity(F.col("categories")).alias("severity"))


def critical_actions(spark, folder):
    return _with_issues(spark, folder).select(
        ID, F.array_join(critical.actions(F.col("categories")), "|").alias("actions_required")
    )


def critical_flags(spark, folder):
    c = F.col("categories")
    return _with_issues(spark, folder).select(
        ID, critical.has_issue(c).alias("has_critical_issue"), critical.escalate(c).alias("should_escalate"),
        critical.has_issue(c).alias("should_override_sentiment"),
    )


def escalations(spark, folder):
    found = _with_issues(spark, folder).filter(F.size("categories") > 0)
    return found.select(ID, critical.escalation(F.col("categories")).alias("message"))


def sarcasm_score(spark, folder):
    raw = sarcasm.score(F.col("reviewText"), F.col("text_lc"))
    df = _with_issues(spark, folder).select(ID, raw.alias("s"))
    s = F.col("s")
    return df.select(ID, sarcasm.is_sarcastic(s).alias("is_sarcastic"), sarcasm.confidence(s).alias("confidence"))


def sarcasm_corrected(spark, folder):
    df = triage.add_sentiment(_with_issues(spark, folder))
    return df.select(
        ID, "original_sentiment", "corrected_sentiment", "sarcasm_detected", "sarcasm_confidence",
        (F.col("original_sentiment") != F.col("corrected_sentiment")).alias("was_corrected"),
    )


def final_sentiment(spark, folder):
    return triage.add_sentiment(_with_issues(spark, folder)).select(ID, "original_sentiment", "sentiment")


def _clause_rows(spark, folder):
    df = aspects.add_clauses(review_view.reviews(spark, folder).select(ID, "reviewText"))
    return df.select(ID, F.posexplode_outer("clauses").alias("clause_no", "c"))


def clauses(spark, folder):
    return _clause_rows(spark, folder).select(ID, "clause_no", "c.clause")


def aspect_mentions(spark, folder):
    lc = F.lower("c.clause")
    found = F.array_compact(F.array(*[F.when(aspects.mentions(lc, a), F.lit(a)) for a in lx.ASPECTS]))
    rows = _clause_rows(spark, folder).select(ID, "clause_no", F.explode_outer(found).alias("aspect"))
    return rows.filter("aspect IS NOT NULL")


def clause_sentiment(spark, folder):
    return _clause_rows(spark, folder).select(
        ID, "clause_no", "c.positive_words", "c.negative_words", "c.sentiment", "c.score", "c.confidence"
    )


def scorer_signed(spark, folder):
    """Signed scores for a scorer output of label and score columns."""
    scored = review_view.scored_reviews(spark, folder)
    label = F.when(F.col("p") >= 3, "POSITIVE").otherwise("NEGATIVE")
    signed = aspects.signed_score(label, F.col("confidence") - F.lit(0.15))
    return scored.select(ID, signed.alias("s")).select(ID, "s.*")


def aspect_sentiment(spark, folder):
    return aspects.aspect_rows(_with_aspects(spark, folder))


def aspects_mentioned(spark, folder):
    df = aspects.add_patterns(_with_aspects(spark, folder))
    return df.select(ID, _joined("aspects_mentioned"), F.col("has_conflict").alias("has_mixed_sentiment"))


def dominant_aspect(spark, folder):
    return _with_aspects(spark, folder).select(ID, aspects.dominant(F.col("aspects")).alias("dominant_aspect"))


def priority_aspects(spark, folder):
    return _with_aspects(spark, folder).select(
        ID, F.array_join(aspects.priority(F.col("aspects")), "|").alias("priority_aspects")
    )


def aspect_pattern(spark, folder):
    df = aspects.add_patterns(_with_aspects(spark, folder))
    return df.select(ID, "pattern", _joined("positive_aspects"), _joined("negative_aspects"), _joined("neutral_aspects"))


def aspect_mismatch(spark, folder):
    return _analysed(spark, folder).select(ID, "sentiment", "mismatch")


def aspect_overall(spark, folder):
    return _with_aspects(spark, folder).select(ID, aspects.overall(F.col("aspects")).alias("dominant_sentiment"))


def response_strategy(spark, folder):
    df = _analysed(spark, folder).withColumn("tone", aspects.tone(F.col("sentiment"), F.col("negative_aspects")))
    listed = aspects.address_list(F.col("tone"), F.col("positive_aspects"), F.col("negative_aspects"))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["aspect"], x["type"], x["priority"])), "|")
    return df.select(
        ID, "tone", "pattern", text.alias("address_aspects"), F.col("has_conflict").alias("has_mixed"),
        F.when(F.col("tone") == "apologetic_urgent", "urgent").otherwise("normal").alias("priority"),
    )


def aspect_report(spark, folder):
    return aspects.corpus_report(_with_aspects(spark, folder))


def aspect_agreement(spark, folder):
    df = aspects.add_patterns(_with_aspects(spark, folder))
    slim = df.select(ID, "reviewRating", "aspect_overall", "aspects_mentioned")
    return triage.agreement(settled(slim, "agreement"))


def full_triage(spark, folder):
    return triage.flat(_triaged(spark, folder))


def batch_score(spark, folder):
    return triage.batch_score(_triaged(spark, folder))


# --- replies ---------------------------------------------------------------

def reply_aspect(spark, folder):
    reply = replies.aspect_reply(F.col("sentiment"), F.col("positive_aspects"), F.col("negative_aspects"))
    return _analysed(spark, folder).select(ID, reply.alias("reply"))


def reply_critical(spark, folder):
    """For every row with an issue, by the label before the override as well as after it."""
    df = triage.add_sentiment(_with_issues(spark, folder)).filter(F.size("categories") > 0)
    return df.select(
        ID,
        replies.critical_reply(F.col("sentiment"), F.col("categories")).alias("reply"),
        replies.critical_reply(F.col("corrected_sentiment"), F.col("categories")).alias("reply_before_override"),
    )


def reply_template(spark, folder):
    df = triage.add_sentiment(_with_issues(spark, folder))
    odd = F.when(F.pmod(ID, F.lit(13)) == 0, "unheard of").otherwise(F.col("corrected_sentiment"))
    return df.select(ID, odd.alias("label"), replies.template(odd).alias("reply"))


def reply_router(spark, folder):
    return _triaged(spark, folder).select(ID, replies.route().alias("route"), "generated_response")


def reply_tone(spark, folder):
    p, n = F.col("positive_aspects"), F.col("negative_aspects")
    df = aspects.add_patterns(_with_aspects(spark, folder))
    return df.select(ID, replies.tone_of(p, n).alias("tone"), replies.tone_reply(F.col(ID), p, n).alias("reply"))


def prompt_batch(spark, folder):
    scored = triage.add_sentiment(triage.add_issues(review_view.inbox(spark, folder)))
    label = F.col("corrected_sentiment")
    return scored.select(ID, replies.prompt_context(label).alias("context"), replies.prompt(label).alias("prompt"))


def reply_tidy(spark, folder):
    ours = review_view.reviews(spark, folder).select(ID, "reviewText")
    return ours.select(ID, replies.tidy(F.col("reviewText")).alias("tidy"))


def reply_wrap(spark, folder):
    df = triage.add_sentiment(_with_issues(spark, folder))
    label = F.col("corrected_sentiment")
    return df.select(ID, replies.wrapped(replies.template(label), label, F.col(ID)).alias("reply"))


EXAMPLES = (
    ("The tea was warm.", "neutral", "Warm tea is a start. What else would you change?"),
    ("Loved every plate!", "amazing", "So did we while cooking. See you."),
)


def prompt_forms(spark, folder):
    """The three other prompt forms side by side."""
    scored = triage.add_sentiment(triage.add_issues(review_view.inbox(spark, folder)))
    label = F.col("corrected_sentiment")
    return scored.select(
        ID, replies.prompt_with_examples(label, EXAMPLES).alias("with_examples"), replies.prompt_tagged(label).alias("tagged"), replies.prompt_plain(label).alias("plain")
    )


def reply_tone_wide(spark, folder):
    """Tone replies from one column per aspect."""
    df = _with_aspects(spark, folder)
    wide = df.select(ID, *[F.get(F.col("aspects"), F.lit(i))["sentiment"].alias(f"{a}_sentiment") for i, a in enumerate(lx.ASPECTS)])
    p, n = F.col("positive_aspects"), F.col("negative_aspects")
    return replies.aspect_lists(wide).select(ID, replies.tone_of(p, n).alias("tone"), replies.tone_reply(F.col(ID), p, n).alias("reply"))


def triage_record(spark, folder):
    return triage.record(_triaged(spark, folder)).drop("generated_response")


def _expected(spark, folder):
    """Triage records with the labels that the star rating leads one to expect."""
    df = triage.record(_triaged(spark, folder)).filter("status = 'success'")
    by_rating = F.when(F.col("reviewRating") >= 4, "positive").when(F.col("reviewRating") <= 2, "negative")
    return triage.expectations(df.select(
        "*", rating_label(F.col("reviewRating"), "amazing").alias("expected_overall"), by_rating.alias("expected_food"), by_rating.alias("expected_service")
    ))


def expectation_check(spark, folder):
    return _expected(spark, folder)


def expectation_summary(spark, folder):
    return triage.expectation_summary(_expected(spark, folder))


# --- reply quality ---------------------------------------------------------

def _dimension(name: str):
    def query(spark, folder):
        return _scored_pairs(spark, folder).select(ID, f"{name}_score")

    return query


def quality_levels(spark, folder):
    return _scored_pairs(spark, folder).select(ID, *[f"{d}_level" for d in lx.DIMENSIONS])


def quality_total(spark, folder):
    return _scored_pairs(spark, folder).select(ID, "response_quality_score")


def quality_grade(spark, folder):
    return _scored_pairs(spark, folder).select(ID, "response_grade")


def quality_batch(spark, folder):
    return _scored_pairs(spark, folder, reply_quality.batch).select(ID, *reply_quality.BATCH_COLUMNS)


def quality_report(spark, folder):
    return reply_quality.quality_report(_scored_pairs(spark, folder))


def grade_distribution(spark, folder):
    return reply_quality.grade_distribution(_scored_pairs(spark, folder))


def quality_extremes(spark, folder):
    return reply_quality.extremes(_scored_pairs(spark, folder))


def improvement_areas(spark, folder):
    return reply_quality.improvement_areas(_scored_pairs(spark, folder))


def quality_by_label(spark, folder):
    return reply_quality.by_label(_scored_pairs(spark, folder))


def reply_ab(spark, folder):
    triaged = triage.triage(review_view.scored_reviews(spark, folder))
    second = replies.tone_reply(F.col(ID), F.col("positive_aspects"), F.col("negative_aspects"))
    pairs = triaged.select(ID, "reviewText", "sentiment", "generated_response", second.alias("aspect_aware_response"))
    compared = reply_quality.compare(pairs).select(ID, "traditional_quality", "aspect_quality", "quality_improvement")
    return reply_quality.comparison_report(settled(compared, "comparison"))


def weakest_dimension(spark, folder):
    return reply_quality.weakest(_scored_pairs(spark, folder))


# --- runs ------------------------------------------------------------------

def _statuses(spark, folder):
    triaged = triage.add_sentiment(triage.add_issues(review_view.inbox(spark, folder)))
    status = F.when(F.col("reviewText").isNull(), "failed").otherwise("success")
    return triaged.withColumn("status", status).select(
        ID, "placeName", "reviewDate", "confidence", "sentiment", "status"
    )


def batch_summary(spark, folder):
    return runs.batch_summary(_statuses(spark, folder))


def running_confidence(spark, folder):
    return runs.running_confidence(settled(_statuses(spark, folder), "statuses"))


def recent_50(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return runs.latest(events, ["ts", "event_id"])


def label_counters(spark, folder):
    return runs.label_counters(settled(_statuses(spark, folder).select("status", "sentiment"), "statuses"))


def head_n(spark, folder):
    """The first 100 reviews by id."""
    return review_view.reviews(spark, folder).orderBy(ID).limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        critical_keywords, critical_severity, critical_actions, critical_flags, escalations,
        sarcasm_corrected, final_sentiment, clauses, aspect_mentions, clause_sentiment, scorer_signed,
        aspect_sentiment, aspects_mentioned, dominant_aspect, priority_aspects, aspect_pattern,
        aspect_mismatch, aspect_overall, response_strategy, aspect_report, aspect_agreement, batch_score,
        prompt_forms, reply_tone_wide, triage_record, expectation_check, expectation_summary,
        reply_aspect, reply_critical, reply_template, reply_router, reply_tone, prompt_batch, reply_tidy,
        reply_wrap, quality_levels, quality_total, quality_grade, quality_batch, quality_report,
        grade_distribution, quality_extremes, improvement_areas, quality_by_label, reply_ab,
        weakest_dimension, batch_summary, running_confidence, recent_50, label_counters, head_n,
    )
}
QUERIES["sarcasm"] = sarcasm_score
QUERIES["triage"] = full_triage
QUERIES.update({f"quality_{d}": _dimension(d) for d in lx.DIMENSIONS})
