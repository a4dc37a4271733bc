"""Writers. Parquet is the default; CSV and JSON exist for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.readers import escaped


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 2_000_000, escape_breaks: bool = False) -> None:
    """CSV with a header and no row index. Blanks are kept, null and '' stay apart.

    With `escape_breaks` a record is one line, and any reader can split the files.
    """
    if escape_breaks:
        df = df.select(*[escaped(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Files that hold one array of objects each, one file for each task; a task without rows writes an empty array."""

    def framed(batches):
        import pyarrow as pa

        before = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(before + text)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"], pa.string())], ["value"])

    texts = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    texts.mapInArrow(framed, "value string").write.mode("errorifexists").text(path)


def report_documents(report: DataFrame, name: str) -> DataFrame:
    """One JSON document per report row: (report, document)."""
    return report.select(
        F.lit(name).alias("report"), F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("document")
    )
