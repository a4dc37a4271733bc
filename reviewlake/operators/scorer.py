"""Pluggable sentiment scorers: train, predict, save, load.

`predict` adds `label`, `confidence` and `probabilities` to a frame with `reviewText`.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.operators import aspects, models, sampling
from reviewlake.session import settled

OUTPUT = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
])


class SentimentScorer(ABC):
    @abstractmethod
    def train(self, df: DataFrame) -> None: ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...

    @abstractmethod
    def load(self, path: str) -> None: ...


class ModelScorer(SentimentScorer):
    """TF-IDF plus a `pyspark.ml` classifier with probabilities.

    Training draws `target` rows per rating (1 to 5; other rows are left out), so it needs a `review_id` and does not grow
    with the corpus.
    """

    def __init__(self, classifier=None, max_terms: int = models.MAX_TERMS, target: int = sampling.TARGET):
        self.classifier = classifier or models.bayes()
        self.max_terms, self.target = max_terms, target
        self.model: PipelineModel | None = None

    def train(self, df: DataFrame) -> None:
        rated = df.filter(F.col("reviewRating").between(1, 5) & F.col("reviewText").isNotNull()).select("review_id", "reviewText", "reviewRating")
        drawn = settled(sampling.balance(rated, self.target), "scorer")
        features = models.fit_tfidf(drawn, self.max_terms)
        ready = models.class_weights(models.featurise(features, drawn))
        self.model = PipelineModel([*features.stages, self.classifier.fit(ready)])

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("train or load a model first")
        scored = models.score(self.model, df)
        return scored.select(*df.columns, F.col("sentiment").alias("label"), "confidence", "probabilities")

    def save(self, path: str) -> None:
        self.model.write().save(path)

    def load(self, path: str) -> None:
        self.model = PipelineModel.load(path)


class LexiconScorer(SentimentScorer):
    """Clause lexicon over the whole text, in built-in expressions; nothing to train."""

    def train(self, df: DataFrame) -> None:
        return None

    def predict(self, df: DataFrame) -> DataFrame:
        scored = aspects.add_clauses(df)
        p = F.aggregate("clauses", F.lit(0), lambda acc, c: acc + c["positive_words"])
        n = F.aggregate("clauses", F.lit(0), lambda acc, c: acc + c["negative_words"])
        counted = scored.withColumn("__p", p).withColumn("__n", n).withColumn("__t", F.col("__p") + F.col("__n"))
        score = F.coalesce((F.col("__p") - F.col("__n")) / F.nullif(F.col("__t"), F.lit(0)), F.lit(0.0))
        return counted.withColumn("__s", score).select(
            *df.columns,
            aspects.banded(F.col("__s"), aspects.CLAUSE_CUT).alias("label"),
            F.least(F.col("__t") / 5.0, F.lit(1.0)).alias("confidence"),
            F.create_map(F.lit("positive"), (1 + F.col("__s")) / 2, F.lit("negative"), (1 - F.col("__s")) / 2).alias("probabilities"),
        )

    def save(self, path: str) -> None:
        return None

    def load(self, path: str) -> None:
        return None


class BatchScorer(SentimentScorer):
    """An external model applied to Arrow batches of texts.

    `loader(path)` runs once per task and returns a function from a Series of
    texts to a frame with the three output columns.
    """

    def __init__(self, loader: Callable[[str | None], Callable[[pd.Series], pd.DataFrame]], path: str | None = None):
        self.loader, self.path = loader, path

    def train(self, df: DataFrame) -> None:
        raise NotImplementedError("train the external model where it lives")

    def predict(self, df: DataFrame) -> DataFrame:
        loader, path = self.loader, self.path

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = loader(path)
            for batch in batches:
                scored = model(batch["reviewText"])
                yield pd.concat([batch, scored.set_index(batch.index)], axis=1)

        return df.mapInPandas(run, T.StructType([*df.schema.fields, *OUTPUT.fields]))

    def save(self, path: str) -> None:
        self.path = path

    def load(self, path: str) -> None:
        self.path = path
