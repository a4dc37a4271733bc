"""Review files as DataFrames. Schemas are explicit: no inference pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import lexicons as lx
from reviewlake.sources import ranged


def string_schema(columns: Sequence[str] = lx.REVIEW_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


REVIEW_PAGE = T.StructType([
    T.StructField("reviews", T.ArrayType(T.StructType([
        T.StructField("user", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("rating", T.DoubleType()),
        T.StructField("iso_date", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("text", T.StringType()),
    ])))
])


def read_reviews_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = lx.REVIEW_COLUMNS,
    na_tokens: Sequence[str] = (),
    *,
    multi_line: bool,
    escaped_breaks: bool = False,
) -> DataFrame:
    """CSV with a header, every column a string; `na_tokens` are read as null.

    Files split anywhere. With `multi_line=True` quoted texts may hold line
    breaks: records are found by byte ranges (`sources.ranged`), which reads
    the files three times. Without it a line with an open quote stops the
    read, so that no row is cut silently. `escaped_breaks` reads what
    `sinks.write_csv(escape_breaks=True)` wrote.
    """
    schema = string_schema(columns)
    options = {"quote": '"', "escape": '"', "nullValue": "\0"}  # an absent value is null, a quoted empty one is ''
    if multi_line:
        df = ranged.read(spark, path, schema, ranged.Csv(), options)
    else:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        torn = spark.read.text(path).filter(quotes % 2 == 1).limit(1).collect()
        if torn:
            raise ValueError(f"a quoted text goes over several lines, read with multi_line=True: {torn[0].value[:80]!r}")
        df = spark.read.schema(schema).option("header", True).options(**options).csv(path)
    if escaped_breaks:
        df = df.select(*[unescaped(F.col(c)).alias(c) for c in df.columns])
    return nullify(df, na_tokens) if na_tokens else df


#: Characters that a line of a file cannot hold as they are, and what stands for them after a backslash.
BREAKS = {"\n": "n", "\r": "r", "\0": "0"}


def escaped(text: Column) -> Column:
    """Backslashes doubled, line breaks and NUL as a backslash and a letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in BREAKS.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`: doubled backslashes step aside as NUL, which an escaped text cannot hold."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for char, letter in BREAKS.items():
        if char != "\0":
            out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    zero = F.split(out, r"\\0", -1)
    return F.array_join(F.transform(zero, lambda part: F.replace(part, F.lit("\0"), F.lit("\\"))), "\0")


def nullify(df: DataFrame, tokens: Sequence[str] = lx.NA_TOKENS) -> DataFrame:
    """Read the given tokens as missing in every string column."""
    return df.select(*[
        F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if t == "string" else F.col(c)
        for c, t in df.dtypes
    ])


def read_reviews_json(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = lx.REVIEW_COLUMNS,
    array_file: bool = False,
) -> DataFrame:
    """Line-delimited JSON, or files that hold one array each, which split anywhere too."""
    schema = string_schema(columns)
    if array_file:
        return ranged.read(spark, path, schema, ranged.JsonArray())
    return spark.read.schema(schema).json(path)


def acquire(spark: SparkSession, path: str, source: str = "local", *, multi_line: bool, id_column: str | None = None, first_id: int = 0) -> DataFrame:
    """Reviews of a named source, `local` (CSV), `json`, or `parquet`, with a `review_id`; NA tokens are null in each.

    The id is the given column, or a number per row from `first_id` on that is unique in this read (`next_id` gives the
    first one that earlier loads have not used). Write the result once (as `daily_run.prepare` does): from then on it is fixed.
    """
    columns = [*lx.REVIEW_COLUMNS, *([id_column] if id_column and id_column not in lx.REVIEW_COLUMNS else [])]
    if source == "local":
        raw = read_reviews_csv(spark, path, columns, multi_line=multi_line)
    elif source == "json":
        raw = read_reviews_json(spark, path, columns, array_file=multi_line)
    elif source == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown source: {source}")
    own = F.monotonically_increasing_id() + F.lit(first_id) if id_column is None else F.col(id_column).cast("long")
    rows = raw.withColumn("__id", own)
    return nullify(rows.drop("review_id")).withColumnRenamed("__id", "review_id")


def next_id(earlier: DataFrame) -> int:
    """The first id above those of a table of earlier loads; 0 for an empty one."""
    last = earlier.agg(F.max("review_id")).first()[0]
    return 0 if last is None else last + 1


def column_presence(df: DataFrame, required: Sequence[str] = lx.REQUIRED_COLUMNS) -> DataFrame:
    """Rows (column, present, rows) for the required columns."""
    facts = [
        F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present")) for c in required
    ]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.explode(F.array(*facts)).alias("f"), "rows").select("f.*", "rows")


def ingest_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing values, in one pass."""
    columns = [c for c in df.columns if c != "review_id"]
    gaps = [F.count_if(F.col(c).isNull()) for c in columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(",".join(columns)).alias("columns"),
        sum(gaps[1:], gaps[0]).alias("missing_values"),
    )


def flatten_pages(pages: DataFrame, json_column: str = "page") -> DataFrame:
    """One row per review of stored review pages; an empty snippet falls back to the text."""
    parsed = pages.withColumn("__p", F.from_json(json_column, REVIEW_PAGE))
    r = F.col("r")
    return parsed.select("page_id", F.explode("__p.reviews").alias("r")).select(
        "page_id",
        r["user"]["name"].alias("authorName"),
        r["rating"].alias("reviewRating"),
        r["iso_date"].alias("reviewDate"),
        F.coalesce(F.nullif(r["snippet"], F.lit("")), r["text"], F.lit("")).alias("reviewText"),
    )
