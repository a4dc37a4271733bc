"""Registered queries: sampling, metrics, fairness on fixed predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import fairness, features, metrics, models, sampling, scorer
from reviewlake.session import settled
from reviewlake.sources import review_view
from reviewlake.sources.tables import table

ID = "review_id"


def _r6(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _scored(spark, folder):
    return review_view.scored_reviews(spark, folder)


def _pairs(spark, folder):
    return _scored(spark, folder).select("y", "p")


def _rated(spark, folder):
    return settled(review_view.reviews(spark, folder).select(ID, "reviewRating"), "rated")


def balance_classes(spark, folder):
    return sampling.balance(_rated(spark, folder))


def stratified_split(spark, folder):
    return sampling.stratified_split(_rated(spark, folder))


def dataset_stats(spark, folder):
    df = features.add_text_length(review_view.reviews(spark, folder))
    return sampling.dataset_stats(settled(df.select("reviewRating", "text_length", "provider"), "stats"))


def eval_weighted(spark, folder):
    df = metrics.weighted_metrics(metrics.pair_counts(_pairs(spark, folder)))
    return _r6(df, "accuracy", "precision", "recall", "f1")


def model_leaderboard(spark, folder):
    """Three fixed predictors side by side: shifted, always five, and one step up."""
    up = F.least(F.lit(5), F.col("y") + F.pmod(ID, F.lit(2)).cast("int"))
    guesses = F.array(*[
        F.struct(F.lit(n).alias("model"), c.cast("int").alias("p"))
        for n, c in (("shifted", F.col("p")), ("majority", F.lit(5)), ("step_up", up))
    ])
    long = _scored(spark, folder).select("y", F.explode(guesses).alias("g")).select("y", "g.*")
    return _r6(metrics.leaderboard(settled(long, "guesses")), "f1")


def tuned_or_baseline(spark, folder):
    scored = settled(_scored(spark, folder).select(ID, "y", "p"), "tuned")
    tuned = scored.withColumn("p", F.when(F.pmod(ID, F.lit(2)) == 0, F.col("y")).otherwise(F.col("p")))
    return _r6(metrics.tuned_or_baseline(scored, tuned), "baseline_f1", "tuned_f1", "improvement")


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_pairs(spark, folder))


def per_class_metrics(spark, folder):
    return _r6(metrics.per_class(_pairs(spark, folder)), "precision", "recall", "f1")


def avg_metrics(spark, folder):
    return _r6(metrics.averages(_pairs(spark, folder)), "precision", "recall", "f1")


def _points(spark, folder):
    c = F.col("confidence")
    scores = F.array(*[F.when(F.col("p") == k, c).otherwise((F.lit(1.0) - c) / 4.0) for k in range(1, 6)])
    return metrics.one_vs_rest(_scored(spark, folder), scores)


def ovr_auc(spark, folder):
    """Five review classes, and the quality mark of the labels against a rule score."""
    reviews = metrics.auc_report(metrics.auc_from(metrics.cumulated(_points(spark, folder))))
    marks = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(1000)) / 1000.0
    points = marks.groupBy(F.lit(1).alias("class"), score.alias("score")).agg(
        F.sum("quality").alias("pos"), (F.count(F.lit(1)) - F.sum("quality")).alias("neg")
    )
    quality = metrics.auc_from(metrics.cumulated(points)).select(F.lit("quality").alias("class"), "auc")
    return _r6(reviews.unionByName(quality), "auc")


def roc_points(spark, folder):
    return _r6(metrics.roc_from(metrics.cumulated(_points(spark, folder))), "threshold", "fpr", "tpr")


def error_sample(spark, folder):
    return metrics.error_sample(_scored(spark, folder))


def confidence_summary(spark, folder):
    return metrics.confidence_summary(_scored(spark, folder))


def confidence_histogram(spark, folder):
    return metrics.histogram(_scored(spark, folder))


def _slices(spark, folder):
    return settled(_scored(spark, folder).select("y", "p", *fairness.SLICES), "slices")


def slice_metrics(spark, folder):
    return _r6(fairness.slice_metrics(_slices(spark, folder)), *metrics.METRICS)


def overall_metrics(spark, folder):
    return _r6(fairness.overall_metrics(_pairs(spark, folder)), *metrics.METRICS)


def _spread(spark, folder):
    df = _slices(spark, folder)
    return fairness.disparities(fairness.slice_metrics(df), fairness.overall_metrics(df))


def slice_disparity(spark, folder):
    return _r6(_spread(spark, folder), "max", "min", "range", "std", "mean", "overall", "max_deviation")


def fairness_violations(spark, folder):
    return _r6(fairness.violations(_spread(spark, folder)), "range")


def fairness_recommendations(spark, folder):
    return fairness.recommendations(fairness.violations(_spread(spark, folder)))


def fairness_report(spark, folder):
    return _r6(fairness.fairness_report(_slices(spark, folder)), "value")


QUERIES = {
    f.__name__: f
    for f in (
        balance_classes, stratified_split, dataset_stats, eval_weighted, model_leaderboard, tuned_or_baseline,
        confusion_matrix, per_class_metrics, avg_metrics, ovr_auc, roc_points, error_sample, confidence_summary,
        confidence_histogram, slice_metrics, overall_metrics, slice_disparity, fairness_violations,
        fairness_recommendations, fairness_report,
    )
}


# --- fitted models: library defaults, except for the number of labelled rows where `_prepared` or `_drawn` prepares them ---

#: Training rows drawn per rating, so that fitting every model ends in minutes. Everything else is the library's default.
#: `tfidf_terms`, `score_reviews` and `train_gbt` take the whole training part.
ROWS_PER_RATING = 100


def _prepared(spark, folder):
    slim = settled(review_view.reviews(spark, folder).select(ID, "reviewText", "reviewRating"), "texts")
    parts = settled(sampling.training_sets(slim, ROWS_PER_RATING), "parts")
    return slim, models.prepare(parts)


def _drawn(spark, folder):
    """As `_prepared`, for queries that only fit: validation and test rows are left out."""
    slim = settled(review_view.reviews(spark, folder).select(ID, "reviewText", "reviewRating"), "texts")
    return slim, models.prepare(settled(sampling.training_part(slim, ROWS_PER_RATING), "parts"))


def _whole(spark, folder, splits=("train", "val")):
    """All rows of these parts: nothing is drawn."""
    slim = settled(review_view.reviews(spark, folder).select(ID, "reviewText", "reviewRating"), "texts")
    parts = sampling.stratified_split(slim).filter(F.col("split").isin(*splits))
    return slim, models.prepare_whole(settled(parts.select("reviewText", "reviewRating", "split"), "parts"))


def tfidf_terms(spark, folder):
    """Vocabulary and weights of the whole training part; nothing is drawn."""
    parts = sampling.stratified_split(settled(review_view.reviews(spark, folder).select(ID, "reviewText", "reviewRating"), "texts"))
    train = settled(parts.filter("split = 'train'").select("reviewText"), "train")
    return models.weight_table(train)


def _trained(name: str):
    def query(spark, folder):
        _, data = _prepared(spark, folder)
        return models.train_report(name, models.MODELS[name](data.rows).fit(data.train), data)

    return query


def train_gbt(spark, folder):
    """On the whole training part, classes balanced by weights; all 150 rounds."""
    _, data = _whole(spark, folder)
    model = models.boosting(data.rows, weight="weight").fit(data.train)
    return models.train_report("GradientBoosting", model, data)


def score_reviews(spark, folder):
    """Every review, not only the test part, by a model of the whole training part. Each distinct text is taken apart once."""
    slim, data = _whole(spark, folder, ("train",))
    scored = models.score_texts(models.logistic(data.rows).fit(data.train), data.features, slim)
    return scored.select(ID, "reviewRating", "sentiment_score", "sentiment", "confidence", F.to_json("probabilities").alias("probabilities"))


def cv_search(spark, folder):
    """All trials of the fastest model; the other four take the same path one at a time."""
    _, data = _drawn(spark, folder)
    return models.cross_validate(models.bayes(), data.train, models.search_space("MultinomialNB", data.rows))[1]


def top_terms(spark, folder):
    _, data = _drawn(spark, folder)
    return models.top_terms(models.logistic(data.rows).fit(data.train), data.features, spark)


def param_sensitivity(spark, folder):
    return models.sensitivity(_prepared(spark, folder)[1])


def scorer_plugin(spark, folder):
    df = scorer.LexiconScorer().predict(review_view.reviews(spark, folder).select(ID, "reviewText"))
    return df.select(ID, "label", "confidence", F.to_json("probabilities").alias("probabilities"))


QUERIES.update({
    "tfidf_terms": tfidf_terms,
    "train_lr": _trained("LogisticRegression"),
    "train_rf": _trained("RandomForest"),
    "train_gbt": train_gbt,
    "train_svc": _trained("LinearSVC"),
    "train_nb": _trained("MultinomialNB"),
    "score_reviews": score_reviews,
    "cv_search": cv_search,
    "top_terms": top_terms,
    "param_sensitivity": param_sensitivity,
    "scorer_plugin": scorer_plugin,
})
