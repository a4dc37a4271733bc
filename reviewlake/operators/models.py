"""TF-IDF features and rating classifiers on `pyspark.ml`.

Training sets are balanced to a fixed number of rows per class (`prepare`), so fitting does
not grow with the corpus, or whole and balanced by weights (`prepare_whole`), so it does;
scoring does, and is a narrow map over its rows.
Defaults are the production settings; pass smaller ones to try things out.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import lexicons as lx
from reviewlake.functions.distributed import text_digest
from reviewlake.functions.labels import class_label
from reviewlake.functions.term_vectors import with_counts
from reviewlake.functions.text import strings
from reviewlake.operators import metrics
from reviewlake.operators.boosting import JointBoosting
from reviewlake.operators.squared_hinge import SquaredHinge
from reviewlake.session import settled

SEED = 42
MAX_TERMS = 10000
C_VALUES = (0.01, 0.1, 1.0, 10.0, 100.0)


def term_counts(train: DataFrame) -> DataFrame:
    """Rows (term, uses, rows) of all words, word pairs and triples: how often each occurs, and in how many texts.

    Equal texts are counted first, so that each is taken apart once. Both numbers come from one pass: the terms of a text are
    sorted, and the first of equal ones stands for the text. A null text has no terms.
    """
    texts = train.groupBy("reviewText").agg(F.count(F.lit(1)).alias("n"))
    words = F.coalesce(F.regexp_extract_all(F.lower("reviewText"), F.lit(r"(\w\w+)"), 1), strings([]))
    cut = texts.select("n", words.alias("words"))

    def run(n: int):
        starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.array_join(F.slice("words", i + 1, F.lit(n)), " "))

    ordered = cut.select("n", F.array_sort(F.concat("words", run(2), run(3))).alias("terms"))
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.coalesce(F.get("terms", i - 1) != t, F.lit(True)).alias("first")))
    rows = ordered.select("n", F.explode(marked).alias("t"))
    return rows.groupBy("t.term").agg(F.sum("n").alias("uses"), F.sum(F.when(F.col("t.first"), F.col("n")).otherwise(0)).alias("rows"))


def frequent_terms(train: DataFrame, max_terms: int = MAX_TERMS, min_df: int = 2, max_df: float = 0.95) -> tuple[int, list]:
    """Number of texts, and (term, uses, rows) of the `max_terms` most frequent terms of at least `min_df` texts and at most the
    share `max_df` of them, ties by the term itself, so it is the same in every run."""
    n = train.count()
    kept = term_counts(train).filter((F.col("rows") >= min_df) & (F.col("rows") <= max_df * n))
    terms = kept.orderBy(F.desc("uses"), "term").limit(max_terms).collect()  # at most `max_terms`
    if not terms:
        raise ValueError("no term is frequent enough for a vocabulary")
    return n, terms


def weight_table(train: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Rows (position, term, idf) as `term_table` of a fit has them, from the counts alone."""
    n, terms = frequent_terms(train, max_terms)
    rows = [(i, t.term, math.log((n + 1) / (t.rows + 1))) for i, t in enumerate(terms)]
    return train.sparkSession.createDataFrame(rows, "position int, term string, idf double")


def _splitting() -> list:
    """Words, word pairs and triples of a text, in `terms`."""
    return [
        RegexTokenizer(inputCol="reviewText", outputCol="words", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        NGram(n=3, inputCol="words", outputCol="triples"),
        SQLTransformer(statement="SELECT *, concat(words, pairs, triples) AS terms FROM __THIS__"),
    ]


def fit_tfidf(train: DataFrame, max_terms: int = MAX_TERMS, min_df: int = 2, max_df: float = 0.95) -> PipelineModel:
    """Words, word pairs and triples -> counts -> idf -> unit length, in `features`; the vocabulary is that of `frequent_terms`."""
    split = _splitting()
    words = [r.term for r in frequent_terms(train, max_terms, min_df, max_df)[1]]
    terms = PipelineModel(split).transform(train.select("reviewText")).select("terms")
    counts = CountVectorizerModel.from_vocabulary(words, inputCol="terms", outputCol="counts")
    idf = IDF(inputCol="counts", outputCol="weights").fit(counts.transform(terms))
    return PipelineModel([*split, counts, idf, Normalizer(p=2.0, inputCol="weights", outputCol="features")])


def tfidf_of_counts(train: DataFrame, max_terms: int = MAX_TERMS) -> PipelineModel:
    """As `fit_tfidf`, from the counts of `frequent_terms` alone: the idf of a term follows from them without another pass."""
    n, terms = frequent_terms(train, max_terms)
    counts = CountVectorizerModel.from_vocabulary([t.term for t in terms], inputCol="terms", outputCol="counts")
    idf = Vectors.dense([math.log((n + 1) / (t.rows + 1)) for t in terms])
    weights = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="weights")
    return PipelineModel([*_splitting(), counts, weights, Normalizer(p=2.0, inputCol="weights", outputCol="features")])


def vocabulary(features: PipelineModel) -> list[str]:
    return features.stages[4].vocabulary


def term_table(features: PipelineModel, spark) -> DataFrame:
    """Rows (position, term, idf); bounded by the vocabulary size."""
    idf = features.stages[5].idf.toArray()
    rows = [(i, t, float(w)) for i, (t, w) in enumerate(zip(vocabulary(features), idf))]
    return spark.createDataFrame(rows, "position int, term string, idf double")


def featurise(features: PipelineModel, df: DataFrame) -> DataFrame:
    """Add `features` and `y`; drop the intermediate columns."""
    out = features.transform(df).drop("words", "pairs", "triples", "terms", "counts", "weights")
    return out.withColumn("y", F.col("reviewRating").cast("int")).withColumn("label", (F.col("y") - 1).cast("double"))


def class_weights(train: DataFrame, times: str | None = None) -> DataFrame:
    """Add `weight` = rows / (classes x rows of the class), times the rows that a row stands for, where `times` names them."""
    counts = train.groupBy("label").agg((F.sum(times) if times else F.count(F.lit(1))).alias("__n"))
    totals = counts.agg(F.struct(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    weights = counts.withColumn("__t", totals).select(
        "label", (F.col("__t.rows") / (F.col("__t.classes") * F.col("__n"))).alias("weight")
    )
    joined = train.join(F.broadcast(weights), "label")  # five rows at most: one per rating
    return joined.withColumn("weight", F.col("weight") * F.col(times)) if times else joined


def logistic(rows: int, max_iter: int = 1000, c: float = 1.0) -> LogisticRegression:
    """L2 strength 1/C on the sum of losses is 1/(C x rows) on their mean; `rows` are the training rows. The strength holds for
    the coefficients of the features as they are."""
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=1.0 / (c * rows), weightCol="weight", standardization=False)


def forest(rows: int | None = None, trees: int = 200, depth: int = 12) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, weightCol="weight", featureSubsetStrategy="sqrt")


def boosting(rows: int | None = None, rounds: int = 150, depth: int = 3, weight: str | None = None) -> JointBoosting:
    """One tree per class and round on probabilities that all classes share; `weight` names the weights of rows."""
    return JointBoosting(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=SEED, **({"weightCol": weight} if weight else {}))


def linear_svc(rows: int, max_iter: int = 1500, c: float = 1.0) -> SquaredHinge:
    """Squared hinge, one class against the rest; as for `logistic`, the strength of C depends on the number of training rows."""
    return SquaredHinge(maxIter=max_iter, regParam=1.0 / (c * rows), weightCol="weight")


def bayes(rows: int | None = None, alpha: float = 0.1) -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", smoothing=alpha)


#: Makers of estimators; each takes the number of training rows.
MODELS = {
    "LogisticRegression": logistic, "RandomForest": forest, "GradientBoosting": boosting,
    "LinearSVC": linear_svc, "MultinomialNB": bayes,
}


@dataclass
class Prepared:
    """Feature model, the featurised parts of one data set and the number of training rows."""

    features: PipelineModel
    train: DataFrame
    val: DataFrame
    test: DataFrame
    rows: int


@dataclass
class Trained:
    """The best model by validation F1, the F1 of each that could be fitted, and the reason for each that could not."""

    name: str | None = None
    model: Model | None = None
    scores: dict[str, float] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        """Rows (model, f1, error)."""
        rows = [(k, v, None) for k, v in self.scores.items()] + [(k, None, v) for k, v in self.failures.items()]
        return spark.createDataFrame(rows, "model string, f1 double, error string")


def prepare(parts: DataFrame, max_terms: int = MAX_TERMS) -> Prepared:
    """Fit features on the training part only; its rows, bounded by balancing, are written out for the passes of fitting."""
    train = parts.filter("split = 'train'")
    features = fit_tfidf(train, max_terms)
    ready = settled(class_weights(featurise(features, train)), "train")
    val, test = (featurise(features, parts.filter(F.col("split") == s)) for s in ("val", "test"))
    return Prepared(features, ready, val, test, ready.count())


def featurise_alike(features: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows (y, label, features, n): each text with each rating once, and how many rows it stands for."""
    alike = rows.groupBy("reviewText", "reviewRating").agg(F.count(F.lit(1)).alias("n"))
    weighed = PipelineModel(features.stages[5:]).transform(with_counts(alike, "reviewText", vocabulary(features)))
    y = F.col("reviewRating").cast("int")
    return weighed.select(y.alias("y"), (y - 1).cast("double").alias("label"), "features", "n")


def prepare_whole(parts: DataFrame, max_terms: int = MAX_TERMS) -> Prepared:
    """As `prepare`, on a training part that is whole: no row is drawn or repeated, classes are balanced by `weight`.

    Rows of equal text and rating are one row with their number in `n` and in `weight`, which leaves every weighted sum of a
    fit as it is. `rows` counts all training rows.
    """
    train, val, test = (parts.filter(F.col("split") == s) for s in ("train", "val", "test"))
    features = tfidf_of_counts(train, max_terms)
    alike = settled(featurise_alike(features, train), "alike")
    cores = parts.sparkSession.sparkContext.defaultParallelism
    if alike.rdd.getNumPartitions() < cores:  # few bytes, but every step of a fit goes over them
        alike = alike.repartition(cores)
    ready = class_weights(alike, "n")
    return Prepared(features, ready, featurise_alike(features, val), featurise_alike(features, test), alike.agg(F.sum("n")).first()[0])


def predictions(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", (F.col("prediction") + 1).cast("int"))


def evaluate(model: Model, df: DataFrame) -> DataFrame:
    """One row: accuracy and weighted F1, precision, recall, support; a row counts `n` times where it has that column."""
    return metrics.weighted_metrics(metrics.pair_counts(predictions(model, df), times="n" if "n" in df.columns else None))


def train_report(name: str, model: Model, data: Prepared) -> DataFrame:
    """Rows (model, split, accuracy, f1, precision, recall, support) for train and val."""
    parts = [
        evaluate(model, df).select(F.lit(name).alias("model"), F.lit(split).alias("split"), "*")
        for split, df in (("train", data.train), ("val", data.val))
    ]
    return parts[0].unionByName(parts[1])


def train_all(data: Prepared, estimators: dict) -> Trained:
    """Fit each estimator and keep the best by validation F1; one that fails is reported and does not stop the others."""
    out = Trained()
    for name, estimator in estimators.items():
        try:
            model = estimator.fit(data.train)
            out.scores[name] = evaluate(model, data.val).first()["f1"]
        except Exception as error:
            out.failures[name] = f"{type(error).__name__}: {error}"
            continue
        if out.model is None or out.scores[name] > out.scores[out.name]:
            out.name, out.model = name, model
    return out


def score(model: Model, df: DataFrame) -> DataFrame:
    """Label, 1-5 score, confidence and label -> probability map."""
    p = vector_to_array("probability")
    out = model.transform(df).withColumn("__p", p)
    return out.withColumn("sentiment_score", (F.col("prediction") + 1).cast("int")).select(
        *df.columns,
        "sentiment_score",
        class_label(F.col("sentiment_score")).alias("sentiment"),
        F.array_max("__p").alias("confidence"),
        F.map_from_arrays(strings(lx.LABELS_AMAZING), F.slice("__p", 1, 5)).alias("probabilities"),
    )


def score_texts(model: Model, features: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with the result of `score`; equal texts have equal scores, so each distinct text is taken apart and scored once.

    Scores are joined by a 256-bit digest, and the texts are counted in Arrow batches: the rows have no text from there on.
    """
    results = ("sentiment_score", "sentiment", "confidence", "probabilities")
    digest = text_digest("reviewText")
    texts = df.select("reviewText").distinct().select(digest.alias("__key"), "reviewText")
    counted = with_counts(texts, "reviewText", vocabulary(features))
    done = settled(score(model, PipelineModel(features.stages[5:]).transform(counted)).select("__key", *results), "scores")
    return df.withColumn("__digest", digest).join(done, F.col("__digest") == F.col("__key")).select(*df.columns, *results)


def search_space(name: str, rows: int, seed: int = SEED, trials: int = 50) -> list[dict]:
    """A seeded sample of settings per model, within fixed ranges (log scale where marked); `rows` are the training rows."""
    rng = random.Random(seed)

    def log(a: float, b: float) -> float:
        return a * (b / a) ** rng.random()

    draw = {
        "LogisticRegression": lambda: {
            "regParam": 1.0 / (rows * log(0.001, 50)), "elasticNetParam": rng.choice([0.0, 1.0]), "maxIter": rng.randint(200, 1500)},
        "RandomForest": lambda: {
            "numTrees": rng.randint(100, 300), "maxDepth": rng.randint(8, 30), "minInstancesPerNode": rng.randint(1, 10),
            "featureSubsetStrategy": rng.choice(["sqrt", "log2"])},
        "GradientBoosting": lambda: {
            "maxIter": rng.randint(80, 300), "stepSize": log(0.01, 0.25), "maxDepth": rng.randint(2, 6),
            "minInstancesPerNode": rng.randint(1, 10), "subsamplingRate": rng.uniform(0.7, 1.0)},
        "LinearSVC": lambda: {"regParam": 1.0 / (rows * log(0.001, 10)), "maxIter": rng.randint(1000, 3000)},
        "MultinomialNB": lambda: {"smoothing": log(0.01, 1.0)},
    }[name]
    return [draw() for _ in range(trials)]


def cross_validate(estimator, train: DataFrame, settings: list[dict], folds: int = 5, parallelism: int = 4):
    """Weighted-F1 cross-validation over explicit settings: (best model, rows of settings and mean F1)."""
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    grid = []
    for s in settings:
        builder = ParamGridBuilder()
        for k, v in s.items():
            builder = builder.addGrid(inner.getParam(k), [v])
        grid.extend(builder.build())
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism, seed=SEED,
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
    ).fit(train)
    rows = [
        (i, ", ".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in s.items()), float(f))
        for i, (s, f) in enumerate(zip(settings, cv.avgMetrics))
    ]
    table = train.sparkSession.createDataFrame(rows, "trial int, settings string, mean_f1 double")
    return cv.bestModel, table


def tune(name: str, estimator, data: Prepared, baseline: Model, settings: list[dict], folds: int = 5):
    """Search, refit the best settings, and keep the tuned model only if it beats the baseline."""
    tuned, table = cross_validate(estimator, data.train, settings, folds)
    old, new = (evaluate(m, data.val).first()["f1"] for m in (baseline, tuned))
    return (tuned if new > old else baseline), table, new - old


def top_terms(model: Model, features: PipelineModel, spark, per_class: int = 20, overall: int = 30) -> DataFrame:
    """Rows (kind, class, rank, term, weight): strongest terms up and down per class and overall.

    Linear models give coefficients, tree models importances; both are bounded
    by classes x vocabulary.
    """
    terms = vocabulary(features)
    rows = []
    if hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        for i, row in enumerate(matrix):
            order = row.argsort()
            for kind, ids in (("positive", order[::-1][:per_class]), ("negative", order[:per_class])):
                rows += [(kind, lx.LABELS_AMAZING[i], r, terms[j], float(row[j])) for r, j in enumerate(ids, 1)]
        strength = abs(matrix).mean(axis=0)
    else:
        strength = model.featureImportances.toArray()
    rows += [("overall", "all", r, terms[j], float(strength[j])) for r, j in enumerate(strength.argsort()[::-1][:overall], 1)]
    return spark.createDataFrame(rows, "kind string, class string, rank int, term string, weight double")


def sensitivity(data: Prepared, values=C_VALUES, max_iter: int = 1000) -> DataFrame:
    """Validation F1 of logistic regression for each C: rows (param, value, f1)."""
    results = []
    for c in values:
        model = logistic(data.rows, max_iter, c).fit(data.train)
        results.append(("C", float(c), evaluate(model, data.val).first()["f1"]))
    schema = T.StructType([
        T.StructField("param", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("f1", T.DoubleType())
    ])
    return data.train.sparkSession.createDataFrame(results, schema)
