"""Running totals and newest reviews of every place, as keyed state of a stream.

Rows may arrive in any order and more than once. A row waits in the state of its place until the watermark has passed its
day; then the day's rows leave in (day, id) order with the totals so far, each exactly once and final, as the batch
`runs.running_confidence` gives them. What the state holds per place is its totals, the rows of open days and its newest
reviews, whatever the stream's length. It lives in the RocksDB store, so open days need not fit in memory, and it restarts from
the checkpoint with the stream.

Results by `kind`: `running` (final, once per row), `late` (the row's day had closed: it is reported and changes nothing),
`repeated` (the same day and id waits already, likewise), `undated` (no day, likewise), `recent` (the newest reviews by rank;
each set has a version and replaces those before it).

A place is one key: a batch sends all its new rows to one task, so the files of a batch bound what a hot place can bring.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from reviewlake.operators.runs import LATEST

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = (
    "kind string, place string, review_id bigint, day date, total_processed bigint, successful bigint, failed bigint, "
    "avg_confidence double, rank int, version bigint"
)
EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000


def _closes(day: dt.date) -> int:
    """The moment a day is over, in milliseconds."""
    return ((day - EPOCH).days + 1) * DAY_MS


class PlaceState(StatefulProcessor):
    def __init__(self, latest: int = LATEST):
        self.n_latest = latest

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n bigint, good bigint, sure decimal(38,12), closed date, version bigint")
        self.open = handle.getMapState("open", "day date, review_id bigint", "good boolean, sure decimal(20,12)")
        self.newest = handle.getListState("newest", "day date, review_id bigint")

    def _facts(self) -> tuple:
        return tuple(self.totals.get()) if self.totals.exists() else (0, 0, Decimal(0), None, 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, good, sure, closed, version = self._facts()
        newest = {tuple(r) for r in self.newest.get()}
        before, days = set(newest), set()
        for row in rows:
            fact = (row.day, row.review_id)
            if row.day is None:
                yield self._row(key, "undated", row.review_id, None)
            elif closed is not None and row.day <= closed:
                yield self._row(key, "late", row.review_id, row.day)
            elif self.open.containsKey(fact):
                yield self._row(key, "repeated", row.review_id, row.day)
            else:
                self.open.updateValue(fact, (row.good, row.sure))
                newest.add(fact)
                days.add(row.day)
        for day in days:
            self.handle.registerTimer(_closes(day))
        top = sorted(newest, reverse=True)[: self.n_latest]
        if set(top) != before:
            version += 1
            self.newest.put(top)
            for rank, (day, review_id) in enumerate(top, 1):
                yield self._row(key, "recent", review_id, day, rank=rank, version=version)
        self.totals.update((n, good, sure, closed, version))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Close every day that the watermark has passed, in order; a later timer of one of them finds nothing."""
        n, good, sure, closed, version = self._facts()
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((tuple(fact), tuple(value)) for fact, value in self.open.iterator() if _closes(fact[0]) <= passed)
        for (day, review_id), (ok, confidence) in due:
            n, good, sure = n + 1, good + ok, sure + (confidence if ok else 0)
            closed = day if closed is None else max(closed, day)
            yield self._row(key, "running", review_id, day, n, good, n - good, float(sure) / good if good else None)
            self.open.removeKey((day, review_id))
        self.totals.update((n, good, sure, closed, version))

    def _row(self, key, kind, review_id, day, n=None, good=None, failed=None, mean=None, rank=None, version=None) -> Row:
        return Row(kind=kind, place=key[0], review_id=review_id, day=day, total_processed=n, successful=good, failed=failed,
                   avg_confidence=mean, rank=rank, version=version)

    def close(self) -> None:
        pass


def place_stream(triaged: DataFrame, delay: str = "2 days", latest: int = LATEST, group: str = "placeName") -> DataFrame:
    """Stateful results of a stream of (review_id, `group`, reviewDate, status, confidence)."""
    spark = triaged.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own state worker sees no shipped files
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    slim = triaged.select(
        F.col(group).alias("place"), "review_id", F.col("reviewDate").alias("day"), ok.alias("good"),
        F.when(ok, F.col("confidence")).otherwise(0.0).cast("decimal(20,12)").alias("sure"),
        F.col("reviewDate").cast("timestamp").alias("at"),
    )
    marked = slim.withWatermark("at", delay).drop("at")  # Spark drops late rows of that column unseen
    return marked.groupBy("place").transformWithState(
        statefulProcessor=PlaceState(latest), outputStructType=RESULT, outputMode="Update", timeMode="EventTime"
    )


def write_places(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One folder for each batch: a batch that runs again replaces its own rows."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        results.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running(spark: SparkSession, path: str) -> DataFrame:
    """The rows of closed days, as `runs.running_confidence` names them."""
    rows = spark.read.parquet(path).filter("kind = 'running'")
    return rows.select("review_id", F.col("place").alias("placeName"), "total_processed", "successful", "failed", "avg_confidence")


def recent(spark: SparkSession, path: str, n: int = LATEST) -> DataFrame:
    """The newest reviews over all places, from the last set of each place."""
    sets = spark.read.parquet(path).filter("kind = 'recent'")
    last = sets.groupBy("place").agg(F.max("version").alias("version"))
    return sets.join(last, ["place", "version"]).select("place", "review_id", "day").orderBy(F.desc("day"), F.desc("review_id")).limit(n)


def recent_of_places(spark: SparkSession, path: str) -> DataFrame:
    """The newest reviews of each place by rank."""
    sets = spark.read.parquet(path).filter("kind = 'recent'")
    versions = W.partitionBy("place")
    return sets.withColumn("__v", F.max("version").over(versions)).filter("version = __v").select("place", "rank", "review_id", "day")
