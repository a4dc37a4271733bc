"""Classifier metrics from (y, p) columns with classes 1..5.

Everything after the first count works on a few rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import n_buckets, running_totals, spread_key, with_bucket
from reviewlake.functions.labels import class_label
from reviewlake.session import settled

N_CLASSES = 5
METRICS = ("accuracy", "f1", "precision", "recall")
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.5, 0.9
BINS = 30


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def pair_counts(df: DataFrame, groups: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Rows per (y, p); `times` names how many rows a row stands for."""
    return df.groupBy(*groups, "y", "p").agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """All 25 cells, zeros included. The grid is 25 rows by construction."""
    spark = df.sparkSession
    grid = spark.range(N_CLASSES * N_CLASSES).select(
        (F.floor(F.col("id") / N_CLASSES) + 1).cast("int").alias("y"),
        (F.col("id") % N_CLASSES + 1).cast("int").alias("p"),
    )
    return grid.join(pair_counts(df), ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(pairs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows (groups, class, tp, support, predicted) from counted (y, p) pairs."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").cast("int").alias("class"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").cast("int").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    long = pairs.select(*groups, F.explode(sides).alias("s")).select(*groups, "s.*")
    return long.groupBy(*groups, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def with_rates(counts: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return counts.select(
        "*",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(tp * 2.0, support + predicted).alias("f1"),
    )


def weighted_metrics(pairs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per group."""
    rates = with_rates(class_counts(pairs, groups))
    n = F.sum("support")
    return rates.groupBy(*groups).agg(
        (F.sum("tp") / n).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("f1", "precision", "recall")],
        n.alias("support"),
    )


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class, named from `terrible` up."""
    rates = with_rates(class_counts(confusion_matrix(df)))
    return rates.select(class_label(F.col("class")).alias("class"), "precision", "recall", "f1", "support")


def averages(df: DataFrame) -> DataFrame:
    """Support-weighted and macro averages over the five classes."""
    rates = with_rates(class_counts(confusion_matrix(df)))
    parts = [F.struct(
        F.lit("weighted").alias("average"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")],
    ), F.struct(
        F.lit("macro").alias("average"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
    )]
    return rates.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def one_vs_rest(df: DataFrame, scores: Column) -> DataFrame:
    """Rows (class, score, pos, neg) per distinct score; `scores` is an array of five."""
    each = F.posexplode(scores).alias("i", "score")
    long = df.select("y", each).select(
        (F.col("i") + 1).alias("class"), "score", (F.col("y") == F.col("i") + 1).cast("long").alias("pos")
    )
    return long.groupBy("class", "score").agg(
        F.sum("pos").alias("pos"), (F.count(F.lit(1)) - F.sum("pos")).alias("neg")
    )


def cumulated(points: DataFrame) -> DataFrame:
    """Add the counts at or above each score: running totals from the top, per class.

    Scores may be as many as rows, so the totals are bucketed, not one window per class.
    """
    stored = settled(points, "roc").withColumn("down", -F.col("score"))
    placed = with_bucket(stored, F.col("down"), n_buckets(stored))
    return running_totals(placed, ["class"], ["down"], ["pos", "neg"]).drop("down")


def auc_from(cum: DataFrame) -> DataFrame:
    """Area under the curve per class, ties counted half, with the class support."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    p, n = F.sum("pos"), F.sum("neg")
    return cum.groupBy("class").agg(
        (area / F.nullif(p.cast("double") * n.cast("double"), F.lit(0.0))).alias("auc"), p.alias("support")
    )


def auc_report(per_class_auc: DataFrame) -> DataFrame:
    """Per class, macro mean and support-weighted mean as rows (class, auc)."""
    auc = F.col("auc")
    means = per_class_auc.agg(
        F.avg(auc).alias("macro"), (F.sum(auc * F.col("support")) / F.sum("support")).alias("weighted")
    )
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.col(k).alias("auc")) for k in ("macro", "weighted")])
    return per_class_auc.select(class_label(F.col("class")).alias("class"), "auc").unionByName(
        means.select(F.explode(rows).alias("r")).select("r.*")
    )


def roc_from(cum: DataFrame) -> DataFrame:
    """Points (class, threshold, fpr, tpr), one per distinct score, plus the origin without threshold."""
    totals = cum.groupBy("class").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = cum.join(F.broadcast(totals), "class").select(  # one row per class: five
        "class", F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("n")).alias("fpr"), ratio(F.col("cum_pos"), F.col("p")).alias("tpr"),
    )
    origin = totals.select("class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def error_sample(df: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Up to `n` wrong rows in pseudo-random order (distributed top-k), with a 200-character preview."""
    wrong = df.filter(F.col("y") != F.col("p")).withColumn("__k", spread_key(F.col("review_id"), seed))
    top = wrong.orderBy("__k", "review_id").limit(n)
    return top.select(
        "review_id",
        F.concat(F.substring("reviewText", 1, 200), F.lit("...")).alias("text"),
        class_label(F.col("y")).alias("true_label"),
        class_label(F.col("p")).alias("predicted_label"),
    )


def leaderboard(df: DataFrame, model: str = "model") -> DataFrame:
    """Weighted F1 per model and which one is best (ties: the first name); null scores never win."""
    f1 = weighted_metrics(pair_counts(df, [model]), [model]).select(model, "f1")
    best = f1.filter("f1 IS NOT NULL").agg(F.min_by(model, F.struct(-F.col("f1"), F.col(model)))).scalar()
    return f1.select(model, "f1", (F.col(model) == best).alias("is_best"))


def tuned_or_baseline(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """Which of two scored frames to keep: the tuned one only if it improves."""
    def f1(df: DataFrame) -> Column:
        return weighted_metrics(pair_counts(df)).select("f1").scalar()

    return baseline.sparkSession.range(1).select(
        f1(baseline).alias("baseline_f1"), f1(tuned).alias("tuned_f1")
    ).select(
        "baseline_f1", "tuned_f1", (F.col("tuned_f1") - F.col("baseline_f1")).alias("improvement"),
        F.when(F.col("tuned_f1") > F.col("baseline_f1"), "tuned").otherwise("baseline").alias("kept"),
    )


def confidence_summary(df: DataFrame) -> DataFrame:
    c, right = F.col("confidence"), F.col("y") == F.col("p")
    return df.agg(
        F.round(F.avg(c), 6).alias("overall_mean_conf"),
        F.round(F.avg(F.when(right, c)), 6).alias("correct_mean_conf"),
        F.round(F.avg(F.when(~right, c)), 6).alias("incorrect_mean_conf"),
        F.count_if(c < LOW_CONFIDENCE).alias("low_conf_samples"),
        F.count_if(c > HIGH_CONFIDENCE).alias("high_conf_samples"),
    )


def histogram(df: DataFrame, column: str = "confidence", bins: int = BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum is in the last bin, empty bins count 0."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    placed = df.select(F.col(column).cast("double").alias("x")).withColumn("s", span)
    width = F.col("s.hi") - F.col("s.lo")
    at = F.when(width > 0, F.floor((F.col("x") - F.col("s.lo")) * bins / F.nullif(width, F.lit(0.0)))).otherwise(0)
    counted = placed.filter("x IS NOT NULL").groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
