"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards with weights. A row descends from the root: at each node every child draws
-ln(u) / weight, u being a hash of the row's key and the child's name, and the least draw wins. A child is chosen in
proportion to its weight. When one child's weight changes, rows only move between it and its siblings, so movement stays
inside the subtrees whose weights change; a new child takes rows and gives none.

`tree` builds the default tree: two shards to a rack, two racks to a region. It grows by a new region, so one more shard
than a multiple of four takes rows into itself alone; one more than other numbers joins the newest region, where rows may
also move between its own shards.

Everything is built-in expressions. Slots are ranks within a shard from one small count per (shard, bucket), so a shard
is never sorted in one task. A null id draws as a key of its own (all null ids together); null text has size 1 and crc32 0;
equal rows get different slots. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.llm import common as C

SHARDS = 8
ROOT = "root"
Tree = Mapping[str, Mapping[str, float]]


def tree(shards: int, weights: Mapping[int, float] | None = None, per_rack: int = 2, racks: int = 2) -> dict[str, dict[str, float]]:
    """Children and their weights by node; leaves are s0, s1, ...; an inner node weighs what it holds."""
    nodes: dict[str, dict[str, float]] = {ROOT: {}}
    for s in range(shards):
        weight = float((weights or {}).get(s, 1.0))
        if weight < 0:
            raise ValueError(f"shard {s} has a negative weight")
        region, rack = f"region{s // (per_rack * racks)}", f"rack{s // per_rack}"
        for parent, child in ((ROOT, region), (region, rack), (rack, f"s{s}")):
            own = nodes.setdefault(parent, {})
            own[child] = own.get(child, 0.0) + weight
    return nodes


def descend(key: Column, nodes: Tree, levels: int = 3) -> Column:
    """Name of the leaf that a key reaches."""
    children = F.create_map(*[x for node, own in nodes.items() for x in (F.lit(node), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in own.items() if w > 0]))])

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node: Column = F.lit(ROOT)
    for _ in range(levels):
        node = F.array_min(F.transform(children[node], draw))["name"]
    return node


def shard_of(key: Column, nodes: Tree) -> Column:
    return F.substring(descend(key, nodes), 2, 10).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add `slot`, 0, 1, ... within each shard, by bucket of a hash of `order` and then by `order`."""
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    cells = placed.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(shard).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(shard, "__bucket").orderBy(*order)
    return placed.withColumn("__row", F.row_number().over(inside)).join(starts, [shard, "__bucket"]).select(*rows.columns, (F.col("__before") + F.col("__row") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text", weights: Mapping[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard of the row in a tree with one shard more."""
    body = C.text_or_empty(text)
    own = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = own.select("*", F.lit("key").alias("law"), shard_of(key, tree(shards, weights)).alias("shard"), shard_of(key, tree(shards + 1, weights)).alias("grown_shard"))
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents` in eight shards."""
    return shard_documents(C.table(spark, folder, "documents"))
