"""Triage as a stream: the same expressions over a streaming frame.

Per-row work has no state. Only the counters keep any: one small row per label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reviewlake.operators import triage


def read_reviews(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder; the batch size bounds the work of one trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def triage_stream(reviews: DataFrame, prediction: str = "p") -> DataFrame:
    return triage.flat(triage.triage(reviews, prediction))


def running_counters(triaged: DataFrame) -> DataFrame:
    """Per label: rows so far and mean confidence; failed rows count as `error`."""
    label = F.when(F.col("status") == "success", F.col("sentiment")).otherwise("error")
    return triaged.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence")
    )


def write_results(triaged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results as Parquet, exactly once, until the folder is worked off."""
    return (
        triaged.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_counters(counters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the full counter table of each batch; it has one row per label."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counters.writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
