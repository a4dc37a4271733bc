"""Time headline queries at one scale and print one JSON line.

BENCH_SF_DIR: data folder; BENCH_CPUS: cores; BENCH_RUNS: timed runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from reviewlake.plans import catalog
from reviewlake.session import build_session, scratch_dir

HEADLINE = (
    "clean_reviews", "features", "restaurant_avg", "duplicate_report", "validation_gate", "anomaly_report",
    "anom_iqr", "bias_report", "stratified_split", "balance_classes", "ovr_auc", "slice_metrics",
    "critical_severity", "sarcasm_corrected", "aspect_sentiment", "aspect_report", "triage", "reply_tone",
    "quality_batch", "batch_summary", "running_confidence",
)


TABLES = ("orders", "customer", "nation", "region", "documents", "labels", "conversations")


def split_inputs(spark, folder: str, files: int) -> str:
    """The tables the queries read, as several files each: a single small file would keep all cores but one idle."""
    target = scratch_dir(spark, "bench")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", master=f"local[{cpus}]", partitions=max(cpus, 2), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    inputs = split_inputs(spark, folder.rstrip("/"), 2 * cpus)
    queries = catalog.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, inputs).write.format("noop").mode("overwrite").save()
            if run or runs == 0:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
