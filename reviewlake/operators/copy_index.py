"""Duplicates over daily loads: an index of digests that grows by a load and never reads old rows again.

The index is a folder of Parquet files, `load=<name>/bucket=<n>`, with one row for each digest that a load brought: the
digest, its kind (`exact` for whole rows, `text` for the text alone) and how often it came. Beside them lies one Bloom filter
for each load, kind and bucket. A new load is counted by itself, as `validation.duplicate_report` counts a frame, and then
only the digests that some filter lets through are looked up, in the buckets that these filters name. Texts are never read
again, and digests only in those buckets.

A load written twice under one name replaces itself, so a failed run is repeated as it was. Names of loads are the order of
their arrival only by convention; counts do not depend on it.

Sizes: a digest is 32 bytes, its filter entry ten bits (about one false pass in a hundred). `buckets` is chosen once, when the
index is made; a bucket of a load should hold some 100 MB.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.distributed import row_digest
from reviewlake.functions import lexicons as lx
from reviewlake.session import settled, ship_package

BITS = 10
HASHES = 7
KINDS = ("exact", "text")
FILTER = "kind string, bucket int, digests bigint, bits binary"
_FILTER = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("digests", pa.int64()), ("bits", pa.binary())])


def _bucket(buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def load_digests(df: DataFrame, buckets: int, columns: Sequence[str] = lx.REVIEW_COLUMNS) -> DataFrame:
    """(kind, bucket, digest, n) of a load: how often each whole row and each text occurs in it."""
    keys = F.array(
        F.struct(F.lit("exact").alias("kind"), row_digest(columns).alias("digest")),
        F.struct(F.lit("text").alias("kind"), row_digest(["reviewText"]).alias("digest")),
    )
    counted = df.select(F.explode(keys).alias("d")).groupBy("d.kind", "d.digest").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("kind", _bucket(buckets).alias("bucket"), "digest", "n")


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """HASHES places in the filter for each digest, from two words of the digest itself."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), 4)
    steps = np.arange(HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (words[:, 1:2] + steps * (words[:, 2:3] | np.uint64(1))) % np.uint64(bits)


def bloom(digests: list[bytes]) -> bytes:
    bits = max(64, BITS * len(digests))
    out = np.zeros(-(-bits // 8) * 8, bool)
    out[_places(digests, bits).ravel().astype(np.int64)] = True
    return bits.to_bytes(8, "little") + np.packbits(out).tobytes()


def passes(filter_: bytes, digests: list[bytes]) -> np.ndarray:
    """Whether each digest may be among those the filter was made of; never false for one that is."""
    bits = int.from_bytes(filter_[:8], "little")
    flags = np.unpackbits(np.frombuffer(filter_, np.uint8, offset=8))
    return flags[_places(digests, bits).astype(np.int64)].all(axis=1)


def add_load(spark: SparkSession, index: str, name: str, df: DataFrame, buckets: int = 64, columns: Sequence[str] = lx.REVIEW_COLUMNS) -> None:
    """Write the digests and filters of a load into the index."""
    ship_package(spark)
    digests = load_digests(df, buckets, columns).repartition("kind", "bucket")
    digests.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{index}/digests/load={name}")
    written = spark.read.schema("digest binary, n bigint, kind string, bucket int").parquet(f"{index}/digests/load={name}")

    def filters(table: pa.Table) -> pa.Table:
        found = table["digest"].to_pylist()
        row = (table["kind"][0].as_py(), table["bucket"][0].as_py(), len(found), bloom(found))
        return pa.Table.from_pylist([dict(zip(_FILTER.names, row, strict=True))], schema=_FILTER)

    made = written.select("kind", "bucket", "digest").groupBy("kind", "bucket").applyInArrow(filters, FILTER)
    made.write.mode("overwrite").parquet(f"{index}/filters/load={name}")


def _filters(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(f"{FILTER}, load string").parquet(f"{index}/filters")


def seen_before(spark: SparkSession, index: str, name: str) -> DataFrame:
    """(kind, digest, n, earlier): the digests of a load that other loads brought too, and how often in all of those."""
    ship_package(spark)
    own = spark.read.schema("digest binary, n bigint, kind string, bucket int").parquet(f"{index}/digests/load={name}")
    others = _filters(spark, index).filter(F.col("load") != name)

    def through(new: pa.Table, old: pa.Table) -> pa.Table:
        digests = new["digest"].to_pylist()
        out = {"load": [], "kind": [], "bucket": [], "digest": []}
        for row in old.to_pylist() if digests else []:
            hit = np.flatnonzero(passes(row["bits"], digests))
            out["load"] += [row["load"]] * len(hit)
            out["kind"] += [row["kind"]] * len(hit)
            out["bucket"] += [row["bucket"]] * len(hit)
            out["digest"] += [digests[i] for i in hit]
        return pa.table(out, schema=pa.schema([("load", pa.string()), ("kind", pa.string()), ("bucket", pa.int32()), ("digest", pa.binary())]))

    pairs = own.select("kind", "bucket", "digest").groupBy("kind", "bucket").cogroup(others.groupBy("kind", "bucket"))
    asked = settled(pairs.applyInArrow(through, "load string, kind string, bucket int, digest binary"), "asked")
    named = [tuple(r) for r in asked.select("load", "kind", "bucket").distinct().collect()]  # at most one per load, kind and bucket
    if not named:
        return own.select("kind", "digest", "n", F.lit(0).cast("long").alias("earlier")).limit(0)
    schema = "digest binary, n bigint"
    parts = [
        spark.read.schema(schema).parquet(*[f"{index}/digests/load={x}/kind={k}/bucket={b}" for x, k, b in named if k == kind]).select(F.lit(kind).alias("kind"), "digest", "n")
        for kind in KINDS if any(k == kind for _, k, _ in named)
    ]
    old = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = asked.select("kind", "digest").distinct()
    earlier = old.join(wanted, ["kind", "digest"], "left_semi").groupBy("kind", "digest").agg(F.sum("n").alias("earlier"))
    return own.select("kind", "digest", "n").join(earlier, ["kind", "digest"])


def load_report(spark: SparkSession, index: str, name: str) -> DataFrame:
    """What a load adds to the duplicate counts of all loads together, as (kind, rows): members of groups of two and more.

    A group that was single before the load counts its old row as well, so the sums of the reports of all loads, in order of
    arrival, are the report of all rows read at once.
    """
    own = spark.read.schema("digest binary, n bigint, kind string, bucket int").parquet(f"{index}/digests/load={name}").select("kind", "digest", "n")
    known = seen_before(spark, index, name).select("kind", "digest", "earlier")
    both = own.join(known, ["kind", "digest"], "left").withColumn("earlier", F.coalesce("earlier", F.lit(0)))
    new = F.when(F.col("earlier") > 1, F.col("n")).when(F.col("earlier") + F.col("n") > 1, F.col("earlier") + F.col("n")).otherwise(0)
    counts = both.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, new)), F.lit(0)).alias(k) for k in KINDS])
    return counts.select(F.col("exact").alias("exact_duplicates"), F.col("text").alias("duplicate_texts")).unpivot(
        [], ["exact_duplicates", "duplicate_texts"], "kind", "rows"
    )


def new_rows(spark: SparkSession, index: str, name: str, df: DataFrame, columns: Sequence[str] = lx.REVIEW_COLUMNS) -> DataFrame:
    """The rows of a load that no other load brought, one of each; only digests that came before are joined to them."""
    known = settled(seen_before(spark, index, name).filter("kind = 'exact'").select(F.col("digest").alias("__digest")), "known")
    return df.withColumn("__digest", row_digest(columns)).join(known, "__digest", "left_anti").dropDuplicates(["__digest"]).drop("__digest")
