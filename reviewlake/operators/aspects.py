"""Clause-level aspect sentiment, computed inside each row.

A review's clauses and aspect scores are arrays of its own row. No explode,
join or shuffle is needed, so the cost grows with the text alone and a long
review cannot make a hot key. Words and keywords of the clauses are found in
one search (`functions/search.py`). Steps are separate columns on purpose:
each is used several times by the next one and must be evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.search import clause_facts
from reviewlake.functions.text import any_hit, strings

CLAUSE_CUT = 0.1
ASPECT_CUT = 0.2
OVERALL_CUT = 0.3
NEGATION_WINDOW = 3


def banded(score: Column, cut: float) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def split_clauses(text: Column, text_lc: Column) -> Column:
    """Clauses around the first contrast marker present, in fixed marker order.

    The split is on that marker as written at its first occurrence, so later
    occurrences in another case do not split.
    """
    marker = F.coalesce(*[F.when(text_lc.contains(m), F.lit(m)) for m in lx.CONTRAST_MARKERS])
    written = text.substr(F.position(marker, text_lc), F.length(marker))
    pattern = F.concat(F.lit("\\Q"), written, F.lit("\\E"))
    return F.when(marker.isNull(), F.array(text)).otherwise(F.split(text, pattern))


_facts = clause_facts(list(lx.ASPECT_KEYWORDS.values()), lx.POSITIVE_WORDS, lx.NEGATIVE_WORDS, lx.NEGATIONS, NEGATION_WINDOW)


def _scored(clause: Column, counts: Column) -> Column:
    p, n = counts["positive_words"], counts["negative_words"]
    total = p + n
    score = F.when(total > 0, (p - n) / F.nullif(total, F.lit(0))).otherwise(0.0)
    return F.struct(
        clause.alias("clause"),
        p.alias("positive_words"),
        n.alias("negative_words"),
        banded(score, CLAUSE_CUT).alias("sentiment"),
        F.round(score, 3).alias("score"),
        F.round(F.least(total / F.lit(5.0), F.lit(1.0)), 3).alias("confidence"),
        counts["about"].alias("about"),
    )


def add_clauses(df: DataFrame, text: str = "reviewText") -> DataFrame:
    """Add `clauses`, an array of scored clauses (lexicon scorer); bit i of `about` says that a clause mentions aspect i.

    Words are runs of letters, with the contracted `n't` as a word of its own; a negation among the three before turns one over.
    """
    staged = df.withColumn("__lc", F.lower(text))
    staged = staged.withColumn("__parts", split_clauses(F.col(text), F.col("__lc")))
    staged = staged.withColumn("__facts", _facts(F.transform("__parts", F.lower)))
    return staged.withColumn(
        "clauses", F.transform("__parts", lambda c, i: _scored(c, F.get("__facts", i)))
    ).drop("__lc", "__parts", "__facts")


def mentions(clause_lc: Column, aspect: str) -> Column:
    return any_hit(clause_lc, lx.ASPECT_KEYWORDS[aspect])


def _mean(items: Column, field: str) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[field])
    return F.when(F.size(items) > 0, total / F.nullif(F.size(items), F.lit(0))).otherwise(0.0)


def add_aspects(df: DataFrame) -> DataFrame:
    """Add `aspects`: for each of the five aspects, in order, its sentiment, mean
    clause score, mean confidence and number of clauses that mention it."""
    def about(i: int) -> Column:
        return F.filter("clauses", lambda c: c["about"].bitwiseAND(F.lit(1 << i)) != 0)

    per_aspect = F.array(*[about(i) for i in range(len(lx.ASPECTS))])
    means = F.transform(
        per_aspect,
        lambda found, i: F.struct(
            i.alias("ordinal"),
            F.get(strings(lx.ASPECTS), i).alias("aspect"),
            F.size(found).alias("num_mentions"),
            _mean(found, "score").alias("mean"),
            _mean(found, "confidence").alias("sure"),
        ),
    )
    staged = df.withColumn("__means", means)
    return staged.withColumn(
        "aspects",
        F.transform(
            "__means",
            lambda m: F.struct(
                m["ordinal"].alias("ordinal"),
                m["aspect"].alias("aspect"),
                F.when(m["num_mentions"] == 0, "not_mentioned").otherwise(banded(m["mean"], ASPECT_CUT)).alias("sentiment"),
                F.round(m["mean"], 3).alias("score"),
                F.round(m["sure"], 3).alias("confidence"),
                m["num_mentions"].alias("num_mentions"),
            ),
        ),
    ).drop("__means")


def _names(aspects: Column, test: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(aspects, test), lambda a: a["aspect"])


def with_sentiment(aspects: Column, sentiment: str) -> Column:
    return _names(aspects, lambda a: a["sentiment"] == sentiment)


def mentioned(aspects: Column) -> Column:
    return _names(aspects, lambda a: a["num_mentions"] > 0)


def dominant(aspects: Column) -> Column:
    """Aspect with the largest abs(score) x confidence; the earlier one wins ties."""
    strength = F.transform(
        F.filter(aspects, lambda a: a["num_mentions"] > 0),
        lambda a: F.struct(
            (F.abs(a["score"]) * a["confidence"]).alias("s"), (-a["ordinal"]).alias("o"), a["aspect"].alias("aspect")
        ),
    )
    return F.array_max(strength)["aspect"]


def priority(aspects: Column) -> Column:
    """Negative aspects, most negative first."""
    ordered = F.array_sort(
        F.transform(
            F.filter(aspects, lambda a: a["sentiment"] == "negative"),
            lambda a: F.struct(a["score"], a["ordinal"], a["aspect"]),
        )
    )
    return F.transform(ordered, lambda a: a["aspect"])


def overall(aspects: Column) -> Column:
    """Label of the mean score of the mentioned aspects."""
    found = F.filter(aspects, lambda a: a["num_mentions"] > 0)
    return banded(_mean(found, "score"), OVERALL_CUT)


def pattern(aspects: Column, positive: Column, negative: Column) -> Column:
    none = ~F.exists(aspects, lambda a: a["num_mentions"] > 0)
    p, n = F.size(positive), F.size(negative)
    return (
        F.when(none, "no_aspects_mentioned")
        .when((p > 0) & (n > 0), "mixed_sentiment")
        .when(n >= 2, "multiple_issues")
        .when(p >= 3, "highly_positive")
        .when(n == 1, "single_issue")
        .otherwise("neutral_or_positive")
    )


def mismatch(label: Column, positive: Column, negative: Column) -> Column:
    """A positive label over a negative aspect, or the reverse."""
    hidden_issue = label.isin("positive", "amazing") & (F.size(negative) > 0)
    hidden_praise = label.isin("negative", "terrible") & (F.size(positive) > 0)
    return F.coalesce(hidden_issue | hidden_praise, F.lit(False))


def add_patterns(df: DataFrame, label: str | None = None) -> DataFrame:
    """Add lists of positive, negative and neutral aspects and what they imply."""
    a, p, n = F.col("aspects"), F.col("positive_aspects"), F.col("negative_aspects")
    staged = (
        df.withColumn("positive_aspects", with_sentiment(a, "positive"))
        .withColumn("negative_aspects", with_sentiment(a, "negative"))
        .withColumn("neutral_aspects", with_sentiment(a, "neutral"))
        .withColumn("aspects_mentioned", mentioned(a))
    )
    return staged.select(
        "*",
        ((F.size(p) > 0) & (F.size(n) > 0)).alias("has_conflict"),
        dominant(a).alias("dominant_aspect"),
        priority(a).alias("priority_aspects"),
        pattern(a, p, n).alias("pattern"),
        overall(a).alias("aspect_overall"),
        (mismatch(F.col(label), p, n) if label else F.lit(False)).alias("mismatch"),
    )


def tone(label: Column, negative: Column) -> Column:
    n = F.size(negative)
    return (
        F.when(label.isin("terrible", "negative") | (n >= 2), "apologetic_urgent")
        .when(n == 1, "apologetic_standard")
        .when(label == "neutral", "appreciative_improving")
        .otherwise("enthusiastic")
    )


def address_list(reply_tone: Column, positive: Column, negative: Column) -> Column:
    """What a reply speaks to: every negative aspect, then at most two positive
    ones if it apologises. array<struct<aspect, type, priority>>"""
    def entry(kind: str, level: str):
        return lambda a: F.struct(a.alias("aspect"), F.lit(kind).alias("type"), F.lit(level).alias("priority"))

    sorry = F.transform(negative, entry("apologize", "high"))
    thanks = F.transform(F.slice(positive, 1, 2), entry("acknowledge", "medium"))
    return F.when(reply_tone.startswith("apologetic"), F.concat(sorry, thanks)).otherwise(sorry)


def signed_score(label: Column, score: Column) -> Column:
    """struct<sentiment, score, confidence> from an external scorer's label and score;
    anything nearer to zero than 0.4 is neutral."""
    positive = label == "POSITIVE"
    signed = F.when(positive, score).otherwise(-score)
    return F.struct(
        F.when(F.abs(signed) < 0.4, "neutral").when(positive, "positive").otherwise("negative").alias("sentiment"),
        F.round(signed, 3).alias("score"),
        F.round(score, 3).alias("confidence"),
    )


def aspect_rows(df: DataFrame) -> DataFrame:
    """Long form: five rows per review.

    The outer form of explode keeps the optimizer from copying the whole aspect
    expression into a "not empty" filter below it; the array is never empty.
    """
    return df.select("review_id", F.explode_outer("aspects").alias("a")).select(
        "review_id", "a.aspect", "a.sentiment", "a.score", "a.confidence", "a.num_mentions"
    )


def corpus_report(df: DataFrame) -> DataFrame:
    """Per aspect: mention rate in percent, sentiment counts and mean score of the mentions."""
    found = F.col("num_mentions") > 0
    s = F.col("sentiment")
    return aspect_rows(df).groupBy("aspect").agg(
        F.round(F.avg(F.when(found, 100.0).otherwise(0.0)), 2).alias("mention_rate"),
        F.count_if(s == "positive").alias("positive_count"),
        F.count_if(s == "negative").alias("negative_count"),
        F.count_if(s == "neutral").alias("neutral_count"),
        F.round(F.avg(F.when(found, F.col("score"))), 6).alias("avg_score"),
    )
