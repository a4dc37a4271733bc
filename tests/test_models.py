import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from reviewlake.functions import distributed as ds
from reviewlake.operators import fairness, metrics, models, runs, sampling, scorer, triage
from reviewlake.session import scratch_dir, settled
from reviewlake.sources import review_view
from reviewlake.streaming import triage_stream


@pytest.fixture(scope="module")
def rated(spark):
    return spark.range(3000).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 3 > 0, 5).when(F.col("id") % 30 == 0, 1).otherwise(2).alias("reviewRating"))


def test_balance_is_exact_and_without_repeats_where_possible(rated):
    got = sampling.balance(rated, target=200).toPandas()
    assert got.groupby("reviewRating").size().to_dict() == {1: 200, 2: 200, 5: 200}
    assert got[got.reviewRating == 5].review_id.is_unique and got[got.reviewRating == 2].review_id.is_unique
    assert got[got.reviewRating == 1].review_id.nunique() <= 100
    again = sampling.balance(rated.repartition(7), target=200).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))


def test_split_is_complete_disjoint_and_stratified(rated):
    got = sampling.stratified_split(rated).toPandas()
    assert len(got) == 3000 and got.review_id.is_unique
    share = got.groupby(["reviewRating", "split"]).size().unstack()
    assert share.loc[5].to_dict() == {"test": 400, "train": 1400, "val": 200}


def test_training_part_never_leaks(rated):
    got = sampling.training_sets(rated, target=50).toPandas()
    train, rest = got[got.split == "train"], got[got.split != "train"]
    assert not set(train.review_id) & set(rest.review_id)
    assert sampling.training_sets(rated, target=50, leaky=True).count() == 150


def test_metrics_against_a_hand_count(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (5, 1)], "y int, p int")
    assert df.count() == sum(r.n for r in metrics.confusion_matrix(df).collect())
    got = {r["class"]: r for r in metrics.per_class(df).collect()}
    assert (got["terrible"].precision, got["terrible"].recall, got["amazing"].f1, got["neutral"].support) == (0.5, 0.5, 0.0, 0)
    assert metrics.weighted_metrics(metrics.pair_counts(df)).first().accuracy == pytest.approx(0.6)


def test_auc_with_ties_against_brute_force(spark):
    data = [(1 + i % 2, (i * 37 % 10) / 10) for i in range(60)]
    df = spark.createDataFrame(data, "y int, s double")
    scores = F.array(F.col("s"), 1 - F.col("s"), *[F.lit(0.0)] * 3)
    got = {r["class"]: r.auc for r in metrics.auc_from(metrics.cumulated(metrics.one_vs_rest(df, scores))).collect()}
    pos, neg = [s for y, s in data if y == 1], [s for y, s in data if y == 2]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got[1] == pytest.approx(want) and got[3] is None


def test_slices_and_violations(spark):
    rows = [("good", 5, 5)] * 20 + [("bad", 5, 1)] * 20 + [("tiny", 1, 1)] * 3
    df = spark.createDataFrame(rows, "provider string, y int, p int")
    s = fairness.slice_metrics(df, ["provider"])
    assert {r.value for r in s.collect()} == {"good", "bad"}
    v = fairness.violations(fairness.disparities(s, fairness.overall_metrics(df))).collect()
    assert {r.severity for r in v} == {"HIGH"} and len(v) == 4


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    got = metrics.histogram(spark.createDataFrame([(float(i),) for i in range(31)], "confidence double")).toPandas()
    assert got["count"].sum() == 31 and len(got) == 30 and got.set_index("bin")["count"][29] == 2


def test_fit_score_save_and_pick_best(spark):
    df = settled(review_view.reviews(spark, DATA).select("review_id", "reviewText", "reviewRating"), "test-texts")
    data = models.prepare(settled(sampling.training_sets(df, target=60), "test-parts"), max_terms=500)
    got = models.train_all(data, {"broken": None, "bayes": models.bayes(), "logistic": models.logistic(data.rows, 10)})
    name, best, scores = got.name, got.model, got.scores
    assert set(scores) == {"bayes", "logistic"} and name == max(scores, key=scores.get) and scores[name] > 0.3
    assert {(r.model, r.f1 is None, r.error is None) for r in got.table(spark).collect()} == {("broken", True, False), ("bayes", False, True), ("logistic", False, True)}
    out = models.score(best, data.test).first()
    assert sum(out.probabilities.values()) == pytest.approx(1) and out.confidence == max(out.probabilities.values())
    plug = scorer.ModelScorer(max_terms=300, target=60)
    plug.train(df)
    path = scratch_dir(spark, "test-model")
    plug.save(path)
    other = scorer.ModelScorer()
    other.load(path)
    assert other.predict(df.limit(5)).count() == 5


def test_batch_scorer_loads_once_per_task(texts):
    def load(path):
        return lambda t: pd.DataFrame({"label": t.str.len().astype(str), "confidence": 1.0, "probabilities": [{"a": 1.0}] * len(t)})

    got = scorer.BatchScorer(load).predict(texts("a", "bbb")).collect()
    assert sorted(r.label for r in got) == ["1", "3"]


def test_stream_equals_batch(spark):
    inbox = review_view.inbox(spark, DATA).limit(300)
    source, out, check = (scratch_dir(spark, n) for n in ("src", "out", "chk"))
    inbox.repartition(3).write.parquet(source)
    batch = triage.flat(triage.triage(spark.read.parquet(source)))
    stream = triage_stream.triage_stream(triage_stream.read_reviews(spark, source, inbox.schema, 1))
    triage_stream.write_results(stream, out, check).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    counts, check2 = scratch_dir(spark, "cnt"), scratch_dir(spark, "chk")
    triage_stream.write_counters(triage_stream.running_counters(stream), counts, check2).awaitTermination()
    last = spark.read.parquet(counts).filter("batch = 2")
    assert last.agg(F.sum("rows")).first()[0] == 300


def test_a_day_of_one_place_is_cut_by_close_ids(spark, monkeypatch):
    """Rows of one place and day spread over buckets that do not fall along the ids, and none without a date or with equal ids is lost."""
    held = []
    monkeypatch.setattr(runs, "running_totals", lambda rows, *more: held.append(rows) or ds.running_totals(rows, *more))
    row = "id + 2000000000 AS review_id, 'p' AS placeName, date'2024-05-01' AS reviewDate, 0.5 AS confidence, 'success' AS status"
    df = spark.range(4000).selectExpr(*row.split(", "))
    odd = spark.createDataFrame([(5, "p", None, 0.5, "failed"), (6, None, None, 0.5, "success")], "review_id long, placeName string, reviewDate date, confidence double, status string")
    got = {r.review_id: (r.total_processed, r.failed) for r in runs.running_confidence(df.unionByName(odd)).collect()}
    assert got == {2000000000 + i: (i + 2, 1) for i in range(4000)} | {5: (1, 1), 6: (1, 0)}
    buckets = [r["__b"] for r in held[0].orderBy("reviewDate", "review_id").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 12
    assert runs.running_confidence(df.limit(0)).count() == 0


def test_running_confidence_matches_a_plain_loop(spark):
    rows = [(i, "hot" if i % 3 else "p", i % 5 != 0, round(0.4 + i % 7 / 10, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "review_id long, placeName string, ok boolean, confidence double").select(
        "*", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("review_id") * 31 % 60).cast("int")).alias("reviewDate"),
        F.when(F.col("ok"), "success").otherwise("failed").alias("status"))
    got = {r.review_id: r for r in runs.running_confidence(df).collect()}
    state = {}
    for r in sorted(df.collect(), key=lambda r: (r.reviewDate, r.review_id)):
        s = state.setdefault(r.placeName, [0, 0, 0.0])
        s[0] += 1
        if r.ok:
            s[1] += 1
            s[2] += r.confidence
        g = got[r.review_id]
        assert (g.total_processed, g.successful) == (s[0], s[1])
        assert g.avg_confidence == (pytest.approx(s[2] / s[1]) if s[1] else None)
    assert len(got) == 500


def test_every_search_space_fits_its_estimator(spark):
    from pyspark.ml.classification import OneVsRest

    for name, make in models.MODELS.items():
        estimator = make(500)
        inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
        space = models.search_space(name, 500)
        assert len(space) == 50 and space == models.search_space(name, 500)
        for settings in space:
            assert all(inner.hasParam(k) for k in settings)
            inner.copy({inner.getParam(k): v for k, v in settings.items()})


def test_keys_mix_any_ranges_of_ids(spark):
    """Two blocks of consecutive ids fall into the parts of a split alike."""
    df = spark.range(2000).selectExpr("IF(id < 1000, id, id + 2000000000) AS review_id", "5 AS reviewRating")
    got = sampling.stratified_split(df).groupBy("split").agg(F.avg((F.col("review_id") < 1000).cast("int")).alias("share")).collect()
    assert all(abs(r.share - 0.5) < 0.1 for r in got)


def test_term_counts_come_from_one_pass_over_distinct_texts(spark):
    """Against a plain count, with repeated and null texts; no term is exploded twice and no join follows."""
    texts = ["Good good soup", "good soup", "a b", None, "Good good soup", "naïve soup, soup!"]
    got = models.term_counts(spark.createDataFrame([(t,) for t in texts], "reviewText string"))
    uses, rows = {}, {}
    for t in texts:
        w = re.findall(r"[a-z0-9_]{2,}", (t or "").lower())
        terms = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        for term in terms:
            uses[term] = uses.get(term, 0) + 1
        for term in set(terms):
            rows[term] = rows.get(term, 0) + 1
    assert {r.term: (r.uses, r["rows"]) for r in got.collect()} == {t: (uses[t], rows[t]) for t in uses}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan


def test_weights_from_counts_equal_the_fit(spark):
    train = review_view.reviews(spark, DATA).select("reviewText").limit(300)
    train = settled(train, "test-weights")
    got = {r.position: (r.term, r.idf) for r in models.weight_table(train, 200).collect()}
    want = {r.position: (r.term, r.idf) for r in models.term_table(models.fit_tfidf(train, 200), spark).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-12) for i in want)
