"""From a raw file to graded replies, and what ingestion guarantees."""

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.operators import models
from reviewlake.plans import daily_run
from reviewlake.session import scratch_dir, settled
from reviewlake.sources import readers, sinks

TEXTS = {1: "It was awful and cold", 2: "Rather bad food", 3: "Nothing special here", 4: "Good noodles", 5: "Great, friendly and clean"}


@pytest.fixture
def raw(spark):
    rows = [
        (f"P{i % 3}", "Town", "web", TEXTS[i % 5 + 1] + f" number {i % 9}", f"2001-0{i % 9 + 1}-11", str(i % 5 + 1), f"A{i}") for i in range(200)
    ]
    rows += [rows[3], rows[3], ("P1", "N/A", "web", None, "2001-01-01", "5", "B"), tuple(lx.REVIEW_COLUMNS)]
    return spark.createDataFrame(rows, readers.string_schema())


@pytest.mark.parametrize("kind", ["local", "json", "parquet"])
def test_prepare_check_train_answer(spark, raw, kind):
    source, target = scratch_dir(spark, "raw"), scratch_dir(spark, "table")
    {"local": sinks.write_csv, "json": sinks.write_json, "parquet": sinks.write_parquet}[kind](raw, source)
    table = daily_run.prepare(spark, source, target, kind, multi_line=False)
    assert table.count() == 203 and table.select("review_id").distinct().count() == 203
    assert table.filter("placeAddress IS NULL").count() == 1  # an NA token, in every format
    assert table.filter("authorName = 'B'").first().reviewText  # a missing text is filled in
    reports = daily_run.check(table, "2002-01-01")
    assert reports["validation"].first().exact_duplicates == 3
    assert all(r.count() >= 0 for r in reports.values())
    if kind == "local":
        trained, scores, fairness = daily_run.train(table, {"bayes": models.bayes()}, target=20)
        assert trained.name == "bayes" and not trained.failures and scores.first().f1 > 0.5 and fairness.count() > 0
        scored = table.select("*", F.col("reviewRating").alias("p"), F.lit(0.9).alias("confidence"))
        replies = daily_run.answer(scored).collect()
        assert len(replies) == 203 and all(r.response_grade for r in replies)


def test_given_ids_are_kept(spark, raw):
    source = scratch_dir(spark, "ids")
    raw.withColumn("ticket", F.monotonically_increasing_id()).write.parquet(source)
    got = settled(readers.acquire(spark, source, "parquet", multi_line=False, id_column="ticket"), "ids")
    assert got.filter("review_id = ticket").count() == raw.count()


def test_open_quotes_are_not_read_silently(spark):
    df = spark.createDataFrame([("a\nb", "c")], "x string, y string")
    path = scratch_dir(spark, "quotes")
    sinks.write_csv(df, path)
    with pytest.raises(ValueError, match="multi_line"):
        readers.read_reviews_csv(spark, path, ["x", "y"], multi_line=False)
    assert readers.read_reviews_csv(spark, path, ["x", "y"], multi_line=True).first().x == "a\nb"


def test_escaped_breaks_round_trip(spark):
    values = [None, "", "plain", "a\nb\r\nc", "back\\slash", "\\n", "\\\\n\n", 'q"uo"te\n"', "nul\0\\0\0", " \\"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "x int, y string")
    path = scratch_dir(spark, "escaped")
    sinks.write_csv(df, path, escape_breaks=True)
    back = readers.read_reviews_csv(spark, path, ["x", "y"], multi_line=False, escaped_breaks=True)
    assert {int(r.x): r.y for r in back.collect()} == dict(enumerate(values))
    lines = spark.read.text(path).count()
    assert lines == len(values) + len([f for f in back.inputFiles()])


def test_two_loads_have_ids_of_their_own(spark, raw):
    tables = []
    for day in (1, 2):
        source, target = scratch_dir(spark, "raw"), scratch_dir(spark, "table")
        sinks.write_csv(raw.withColumn("reviewDate", F.lit(f"2001-01-0{day}")), source)
        tables.append(daily_run.prepare(spark, source, target, multi_line=True, earlier=tables[0] if tables else None))
    both = tables[0].unionByName(tables[1])
    assert both.select("review_id").distinct().count() == both.count() == 406
    assert readers.next_id(both.limit(0)) == 0 and readers.next_id(tables[0]) > tables[0].agg(F.max("review_id")).first()[0]
