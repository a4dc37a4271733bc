"""Quality of replies: four scored dimensions, a weighted total and a grade.

All scores are expressions of one row. Reports are single aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions import text as tx
from reviewlake.functions.distributed import pinned
from reviewlake.functions.search import Found, grading
from reviewlake.operators.aspects import NEGATION_WINDOW

TARGET = 8
WEAK = 6
_search, _found = grading(
    [
        p for phrases in (
            lx.EMPATHY_HIGH, lx.EMPATHY_MEDIUM, lx.APPRECIATION_WORDS, lx.GENERIC_PHRASES, lx.SPECIFIC_TERMS, lx.ACTION_WORDS,
            lx.CONTACT_PHRASES, lx.RESOLUTION_PHRASES, lx.RETURN_PHRASES, lx.CASUAL_TERMS,
        ) for p in phrases
    ],
    lx.PRONOUNS, lx.POSITIVE_WORDS, lx.NEGATIVE_WORDS, lx.NEGATIONS, NEGATION_WINDOW,
)


def _clamped(score: Column, floor: bool = True) -> Column:
    top = F.least(score, F.lit(10.0))
    return F.greatest(top, F.lit(0.0)) if floor else top


def empathy(reply: Column, found: Found, pronouns: Column) -> Column:
    """Capped at 10, without a floor."""
    marks = tx.occurrences(reply, "!")
    shouting = F.when(marks.isin(1, 2), 1.0).when(marks > 3, -1.0).otherwise(0.0)
    return _clamped(
        found.n_hits(lx.EMPATHY_HIGH) * F.lit(3.0)
        + found.n_hits(lx.EMPATHY_MEDIUM) * F.lit(1.5)
        + pronouns * F.lit(0.5)
        + shouting,
        floor=False,
    )


def specificity(found: Found, positive: Column, reply_words: Column, review_words: Column, n_words: Column) -> Column:
    """`reply_words` and `review_words` are distinct plain words; a missing review has none."""
    thanks = F.when(found.any_hit(lx.APPRECIATION_WORDS), 3.0).otherwise(0.0)
    short_ok = F.when(n_words < 15, -1.0).when(n_words > 60, -0.5).otherwise(1.0)
    reused = F.size(F.array_intersect(review_words, reply_words)) / F.greatest(F.size(review_words), F.lit(1))
    detail = (
        found.n_hits(lx.GENERIC_PHRASES) * F.lit(-1.5) + found.n_hits(lx.SPECIFIC_TERMS) * F.lit(2.0) + reused * F.lit(4.0)
    )
    long_ok = F.when(n_words < 25, -2.0).when(n_words > 100, -1.0).otherwise(1.0)
    return _clamped(F.when(positive, F.lit(5.0) + thanks + short_ok).otherwise(F.lit(5.0) + detail + long_ok))


def actionability(found: Found, positive: Column, negative: Column) -> Column:
    contact = F.when(found.any_hit(lx.CONTACT_PHRASES), 3.0).otherwise(0.0)
    resolution = F.when(negative, F.when(found.any_hit(lx.RESOLUTION_PHRASES), 3.0).otherwise(-2.0)).otherwise(0.0)
    invite = F.when(positive & found.any_hit(lx.RETURN_PHRASES), 2.0).otherwise(0.0)
    return _clamped(found.n_hits(lx.ACTION_WORDS) * F.lit(2.0) + contact + resolution + invite)


def has_caps_word(reply: Column) -> Column:
    """A word of four or more characters with letters, none of them lower-case."""
    return F.exists(
        F.split(reply, f"{lx.SPACE}+"),
        lambda w: (F.length(w) > 3) & (w == F.upper(w)) & (w != F.lower(w)),
    )


def professionalism(reply: Column, found: Found, harsh: Column, n_words: Column) -> Column:
    def minus(condition: Column, points: float) -> Column:
        return F.when(condition, -points).otherwise(0.0)

    first = F.substring(reply, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return _clamped(
        F.lit(10.0)
        + minus(harsh, 2.0)
        + found.n_hits(lx.CASUAL_TERMS) * F.lit(-1.5)
        + minus(~capital, 1.0)
        + minus(~F.substring(reply, -1, 1).isin(".", "!", "?"), 0.5)
        + minus(reply.contains("!!"), 2.0)
        + minus(has_caps_word(reply), 2.0)
        + minus(n_words < 10, 2.0)
    )


def is_harsh(p: Column, n: Column) -> Column:
    """Lexicon polarity (p - n) / (p + n) below -0.5."""
    return (p - n) / F.nullif((p + n), F.lit(0)) < -0.5


def level(score: Column, dimension: str) -> Column:
    high, medium = (8, 6) if dimension == "professionalism" else (7, 4)
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")


def grade(total: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, least in lx.GRADES:
        out = out.when(total >= least, name)
    return out.otherwise("F")


def score_replies(df: DataFrame, reply: str = "generated_response", review: str = "reviewText", label: str = "sentiment") -> DataFrame:
    """Add raw and rounded dimension scores, levels, total and grade.

    An empty reply has no dimensions, total 0 and grade F.
    """
    r = F.col(reply)
    # Pinned: the search would have the steps behind a derived reply copied into one expression.
    staged = pinned(df.withColumn("__rl", F.lower(F.coalesce(review, F.lit("")))), "__lc", F.lower(r))
    staged = (
        staged.withColumn("__found", _search(F.col("__lc")))
        .withColumn("__n", tx.word_count(r))
        .withColumn("__pos", F.coalesce(F.col(label).isin(*lx.POSITIVE_LABELS), F.lit(False)))
        .withColumn("__neg", F.coalesce(F.col(label).isin(*lx.NEGATIVE_LABELS), F.lit(False)))
    )
    # For a positive label the words of reply and review are not compared.
    staged = staged.withColumn("__reply_words", F.when(~F.col("__pos"), tx.plain_words(F.col("__lc"))))
    staged = staged.withColumn("__review_words", F.when(~F.col("__pos"), tx.plain_words(F.col("__rl"))))
    filled = r.isNotNull() & (r != "")
    n, pos, neg, facts = F.col("__n"), F.col("__pos"), F.col("__neg"), F.col("__found")
    found, harsh = _found(facts), is_harsh(facts["positive_words"], facts["negative_words"])
    raw = {
        "empathy": empathy(r, found, facts["pronouns"]),
        "specificity": specificity(found, pos, F.col("__reply_words"), F.col("__review_words"), n),
        "actionability": actionability(found, pos, neg),
        "professionalism": professionalism(r, found, F.coalesce(harsh, F.lit(False)), n),
    }
    scored = staged.select(
        *df.columns, "__pos", "__neg", *[F.when(filled, v).alias(f"{k}_raw") for k, v in raw.items()]
    )
    scored = scored.select("*", *[F.round(f"{d}_raw", 1).alias(f"{d}_score") for d in lx.DIMENSIONS])

    def weighted(kind: str) -> Column:
        parts = [F.col(f"{d}_score") * F.lit(w) for d, w in zip(lx.DIMENSIONS, lx.QUALITY_WEIGHTS[kind])]
        return reduce(lambda a, b: a + b, parts)

    total = F.when(neg, weighted("negative")).when(pos, weighted("positive")).otherwise(weighted("neutral"))
    graded = scored.withColumn("quality_raw", F.coalesce(total, F.lit(0.0)))
    return graded.select(
        *[c for c in graded.columns if c not in ("__pos", "__neg")],
        *[level(F.col(f"{d}_raw"), d).alias(f"{d}_level") for d in lx.DIMENSIONS],
        F.round("quality_raw", 2).alias("response_quality_score"),
        grade(F.col("quality_raw")).alias("response_grade"),
    )


BATCH_COLUMNS = ("response_quality_score", "response_grade", *[f"{d}_score" for d in lx.DIMENSIONS])


def batch(df: DataFrame) -> DataFrame:
    """The input with the six result columns."""
    return score_replies(df).select(*df.columns, *BATCH_COLUMNS)


def quality_report(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_responses"),
        F.round(F.avg("response_quality_score"), 2).alias("average_quality_score"),
        *[F.round(F.avg(f"{d}_score"), 2).alias(d) for d in lx.DIMENSIONS],
    )


def grade_distribution(scored: DataFrame) -> DataFrame:
    """Count and percentage of all six grades, zeros included, from one aggregate."""
    wide = scored.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col("response_grade") == g).alias(g) for g in lx.GRADE_ORDER]
    )
    long = wide.unpivot("__n", list(lx.GRADE_ORDER), "grade", "count")
    return long.select(
        "grade", "count",
        F.coalesce(F.round(F.col("count") * 100.0 / F.nullif(F.col("__n"), F.lit(0)), 2), F.lit(0.0)).alias("percentage"),
    )


def extremes(scored: DataFrame, review: str = "reviewText", reply: str = "generated_response") -> DataFrame:
    """Best and worst reply (ties: smallest id first, largest id last), with 100-character previews.

    One aggregate of small structs; nothing is sorted.
    """
    fields = F.struct(
        "review_id",
        F.col("response_quality_score").alias("score"),
        F.col("response_grade").alias("grade"),
        F.substring(F.coalesce(reply, F.lit("")), 1, 100).alias("response"),
        F.substring(F.coalesce(review, F.lit("")), 1, 100).alias("review"),
    )
    key = F.struct("response_quality_score", -F.col("review_id"))
    both = scored.agg(F.max_by(fields, key).alias("best"), F.min_by(fields, key).alias("worst"))
    row = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("best", "worst")]
    return both.select(F.explode(F.array(*row)).alias("r")).select("r.kind", "r.v.*")


def improvement_areas(scored: DataFrame) -> DataFrame:
    """Dimensions whose mean is under 6, with the gap to 8 and its rank."""
    means = quality_report(scored).unpivot("total_responses", list(lx.DIMENSIONS), "dimension", "current_score")
    weak = means.filter(F.col("current_score") < WEAK)
    return weak.select("dimension", "current_score", F.round(TARGET - F.col("current_score"), 2).alias("gap")).orderBy(
        F.desc("gap")
    )


def by_label(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sentiment").agg(
        F.round(F.avg("response_quality_score"), 6).alias("avg_quality")
    ).orderBy("avg_quality")


def compare(df: DataFrame, first: str = "generated_response", second: str = "aspect_aware_response") -> DataFrame:
    """Add `traditional_quality`, `aspect_quality` and their difference."""
    one = score_replies(df, reply=first).select(*df.columns, F.col("response_quality_score").alias("traditional_quality"))
    two = score_replies(one, reply=second).select(*one.columns, F.col("response_quality_score").alias("aspect_quality"))
    return two.withColumn("quality_improvement", F.col("aspect_quality") - F.col("traditional_quality"))


def comparison_report(compared: DataFrame, top: int = 3) -> DataFrame:
    """Means, mean gain, rows improved, and the ids with the largest gains."""
    best = compared.select("review_id", "quality_improvement").orderBy(
        F.desc(F.round("quality_improvement", 2)), "review_id"
    ).limit(top)
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("quality_improvement", 2)).alias("g"), "review_id")))
    ids = best.agg(F.array_join(F.transform(ranked, lambda x: x["review_id"].cast("string")), ",")).scalar()
    gain = F.col("quality_improvement")
    return compared.agg(
        F.round(F.avg("traditional_quality"), 6).alias("traditional_average"),
        F.round(F.avg("aspect_quality"), 6).alias("aspect_average"),
        F.round(F.avg(gain), 6).alias("average_improvement"),
        F.count_if(gain > 0).alias("improved"),
        F.round(F.avg(F.when(gain > 0, 100.0).otherwise(0.0)), 2).alias("improved_pct"),
    ).select("*", ids.alias("top_ids"))


def weakest(scored: DataFrame) -> DataFrame:
    """The lowest dimension of each reply; the earlier dimension wins ties."""
    pairs = F.array(*[
        F.struct(F.col(f"{d}_score").alias("score"), F.lit(i).alias("o"), F.lit(d).alias("dimension"))
        for i, d in enumerate(lx.DIMENSIONS)
    ])
    low = F.array_min(pairs)
    present = F.col("empathy_score").isNotNull()
    return scored.select(
        "review_id", F.when(present, low["dimension"]).alias("weakest"), F.when(present, low["score"]).alias("score")
    )
