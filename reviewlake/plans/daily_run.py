"""End-to-end runs: prepare and check a raw file, train models, triage, grade replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators import anomaly, bias, cleaning, fairness, features, metrics, models, reply_quality, sampling, triage, validation
from reviewlake.session import settled
from reviewlake.sources import readers, sinks


def prepare(
    spark: SparkSession, source: str, target: str, kind: str = "local", *, multi_line: bool, id_column: str | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Raw reviews -> feature table with a `review_id`, written once as Parquet and read back.

    The acquired rows are written first, so that ids are fixed before anything else reads them. With the table of
    `earlier` loads, ids go on after its last one.
    """
    first = readers.next_id(earlier) if earlier is not None else 0
    raw = settled(readers.acquire(spark, source, kind, multi_line=multi_line, id_column=id_column, first_id=first), "acquired")
    sinks.write_parquet(features.create_features(cleaning.clean_reviews(raw)), target)
    return spark.read.parquet(target)


def check(df: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The three reports over a feature table with a `review_id`, lazily; they are independent."""
    return {
        "validation": validation.gate(df),
        "missing": validation.missing_report(df),
        "bias": bias.bias_report(df),
        "anomalies": anomaly.anomaly_report(df, as_of),
    }


def train(df: DataFrame, estimators: dict | None = None, target: int = sampling.TARGET, leaky: bool = False):
    """Split, balance, fit every model, keep the best, and check it over slices.

    Returns what was trained (best model, scores, failures), test metrics and the
    fairness report; the last two are None if no model could be fitted.
    """
    parts = sampling.training_sets(df, target, leaky)
    data = models.prepare(parts)
    trained = models.train_all(data, estimators or {k: make(data.rows) for k, make in models.MODELS.items()})
    if trained.model is None:
        return trained, None, None
    scored = models.predictions(trained.model, data.test)
    return trained, metrics.weighted_metrics(metrics.pair_counts(scored)), fairness.fairness_report(scored)


def answer(scored: DataFrame, prediction: str = "p") -> DataFrame:
    """Triage every review and grade its reply; no row cap."""
    triaged = triage.triage(scored.drop("sentiment"), prediction)  # the label by rating gives way to the triaged one
    kept = triaged.select("review_id", "status", "reviewText", "sentiment", "confidence", "generated_response")
    return reply_quality.score_replies(kept)
