"""Keyed state of places: shuffled micro-batches, late and repeated rows, restart from a checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import runs
from reviewlake.session import scratch_dir
from reviewlake.streaming import place_state, triage_stream

SCHEMA = "review_id long, placeName string, reviewDate date, status string, confidence double"
FAR = dt.date(2030, 1, 1)


def reviews(n=240, seed=9):
    rng = random.Random(seed)
    places = ["hot"] * 6 + ["A", "B", None]
    return [(i, rng.choice(places), dt.date(2001, 1, 1) + dt.timedelta(days=rng.randrange(20)), rng.choice(["success", "success", "failed"]), rng.choice([0.1, 0.25, 0.333])) for i in range(n)]


@pytest.fixture
def stream(spark):
    """Append rows as a file of their own and run the stream over what is new, on one checkpoint."""
    source, out, check = (scratch_dir(spark, x) for x in ("in", "out", "check"))

    def run(*files, delay="60 days", latest=5):
        for rows in files:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        frame = triage_stream.read_reviews(spark, source, spark.createDataFrame([], SCHEMA).schema, 1)
        query = place_state.write_places(place_state.place_stream(frame, delay, latest), out, check)
        query.awaitTermination()
        assert query.exception() is None
        return out

    return run


def rows_of(df):
    return sorted((r.review_id, r.placeName, r.total_processed, r.successful, r.failed, r.avg_confidence and round(r.avg_confidence, 12)) for r in df.collect())


def test_shuffled_batches_and_restart_equal_the_batch_query(spark, stream):
    rows = reviews()
    shuffled = random.Random(1).sample(rows, len(rows))
    parts = [shuffled[i::4] for i in range(4)]
    parts[1] = parts[1] + parts[1][:7]  # repeated inside a file
    parts[3] = parts[3] + parts[0][:5]  # and over files
    stream(*parts[:2])
    out = stream(*parts[2:])  # a new query on the same checkpoint
    assert place_state.running(spark, out).count() == 0  # nothing is final before the watermark passes
    out = stream([(10**6, "closing", FAR, "success", 0.5)])
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(place_state.running(spark, out)) == rows_of(runs.running_confidence(table))
    newest = runs.latest(table, ["reviewDate", "review_id"], 5)
    got = place_state.recent(spark, out, 6).filter("place is null or place != 'closing'")
    assert sorted(r.review_id for r in got.collect()) == sorted(r.review_id for r in newest.collect())
    per_place = place_state.recent_of_places(spark, out).filter("place = 'hot'").orderBy("rank").collect()
    hot = sorted(((r[2], r[0]) for r in rows if r[1] == "hot"), reverse=True)[:5]
    assert [(r.day, r.review_id) for r in per_place] == hot
    repeated = spark.read.parquet(out).filter("kind = 'repeated'").agg(F.count("*")).first()[0]
    assert repeated == 12


def test_late_and_undated_rows_are_reported(spark, stream):
    day = lambda d: dt.date(2001, 1, d)
    stream([(1, "A", day(1), "success", 0.5), (2, "A", day(2), "failed", 0.5)], delay="1 days")
    stream([(3, "A", day(20), "success", 0.25)], delay="1 days")
    out = stream([(4, "A", day(2), "success", 0.5), (1, "A", day(1), "success", 0.5), (5, "A", None, "success", 0.5)], delay="1 days")
    kinds = sorted((r.kind, r.review_id) for r in spark.read.parquet(out).filter("kind != 'recent'").collect())
    assert kinds == [("late", 1), ("late", 4), ("running", 1), ("running", 2), ("undated", 5)]
    assert rows_of(place_state.running(spark, out)) == [(1, "A", 1, 1, 0, 0.5), (2, "A", 2, 1, 1, 0.5)]
