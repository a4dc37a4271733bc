"""Work on distinct texts against work on every row."""

from pyspark.sql import functions as F

from reviewlake.functions.distributed import once_per
from reviewlake.plans import triage_queries


def test_equal_texts_are_worked_on_once(spark):
    rows = [(i, ("a", "b", None, "")[i % 4], i % 3) for i in range(60)] + [(7, "a", None), (None, "c", 1), (7, "a", None)]
    df = spark.createDataFrame(rows, "id long, t string, p int")
    seen = []

    def work(texts):
        seen.append(texts.count())
        return texts.withColumn("out", F.concat_ws("-", F.coalesce("t", F.lit("null")), "p"))

    got = once_per(df, "t", ["p"], work, "worked").select("id", "t", "p", "out").collect()
    assert seen == [14]
    assert sorted(map(str, got)) == sorted(map(str, work(df).select("id", "t", "p", "out").collect()))


def test_grades_are_joined_to_rows_and_not_found_for_each(spark):
    plan = triage_queries.quality_total(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ours = plan.split("Union")[1]
    assert "Join" in ours and plan.count("Generate explode") == 1  # the replies of conversations alone are graded per row
