"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, at first its bytes. Each level

1. joins runs of one symbol, so neighbours differ,
2. tosses deterministic coins: a symbol's label is twice the lowest bit in which it differs from its left neighbour, plus
   that bit; repeated until labels are below 6, neighbours still differing,
3. begins a phrase at each local maximum of the labels and names it by what it holds.

Labels and maxima depend on a few neighbours only, so equal substrings get equal phrases inside, wherever they stand. Each
level's phrases are the next level's symbols; LEVELS levels make phrases of about 25 bytes. The fingerprint is the K
least 32-bit hashes of a text's distinct phrase names, in hexadecimal, in order. Likeness of two fingerprints is the share
of the K least of both together that both have: an estimate of the Jaccard similarity of the phrase sets, exact for sets
of up to K names. Empty (and null) texts have an empty fingerprint, of likeness 1 to each other and 0 to others.

`with_next` brings each document together with its successor: rows are dealt to ranges of ids, each range also gets the
first row of the one after it, and every text moves once. There are at most MAX_RANGES ranges, so what is known of them is
bounded; a range is sorted on disk and read as a stream, whatever its size. Null ids come last; of equal ids the order is by text.
Repeated rows follow each other. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

LEVELS = 3
K = 64
RANGE_BYTES, MAX_RANGES = 16 << 20, 8192


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coins of 64-bit symbols, tossed four times: labels are below 128, 14, 8 and then 6. `first` marks where documents begin."""
    for _ in range(4):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = x[first] ^ x.dtype.type(1)
        differ = x ^ left
        low = np.bitwise_count((differ & -differ) - x.dtype.type(1))
        x = (2 * low + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    return x


def phrases(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Name and document number of every phrase of the last level."""
    n = len(data)
    if not n:
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    marks = C.Rolling(data)
    heads = offsets[:-1][np.diff(offsets) > 0]  # where documents that are not empty begin
    x, at = data, np.arange(n)
    first = np.zeros(n, bool)
    first[heads] = True
    for _ in range(levels):
        keep = np.ones(len(x), bool)
        keep[1:] = x[1:] != x[:-1]
        keep |= first
        at, first = at[keep], first[keep]
        label = _labels(marks.names(at, np.append(at[1:], n)), first)  # a run is one symbol, named by what it holds
        peak = first.copy()
        peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
        at, first = at[peak], first[peak]
        x = marks.names(at, np.append(at[1:], n))
    return x, np.searchsorted(heads, at, "right") - 1


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The K least phrase hashes of each text, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    name, of = phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return [np.zeros(0, np.uint32)] * len(texts)
    keys = np.unique((of.astype(C.U64) << C.U64(32)) | (name >> C.U64(32)))
    ends = np.searchsorted(keys, np.arange(1, len(full) + 1, dtype=C.U64) << C.U64(32))
    out = [np.zeros(0, np.uint32)] * len(texts)
    low = (keys & C.U64(0xFFFFFFFF)).astype(np.uint32)
    for j, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        out[full[j]] = low[lo : min(hi, lo + K)]
    return out


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    if not x and not y:
        return 1.0
    least = sorted(x | y)[:K] if max(len(x), len(y)) >= K else x | y
    return len(x & y & set(least)) / len(least)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fingerprint of every document; no shuffle."""

    def each(batches):
        for batch in C.slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([to_hex(s) for s in sketches(texts)], pa.string())], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_column).alias("doc_id"), C.text_or_empty(text).alias("text"))
    return slim.mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_column]}, fingerprint string")


def _ranges(docs: DataFrame, key: Column, count: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Edges of ranges of the key, descending, and for each range that has rows: (first key, its number, number of the one before)."""
    probs = [i / count for i in range(1, count)]
    edges = sorted(set(docs.agg(F.percentile_approx(key, F.array(*map(F.lit, probs)), F.lit(10 * count))).first()[0] or []), reverse=True) if probs else []
    firsts = docs.groupBy(_range_of(key, edges).alias("r")).agg(F.max(key).alias("k")).orderBy("r").collect()
    return edges, [(x.k, x.r, firsts[j - 1].r) for j, x in enumerate(firsts)]


def _range_of(key: Column, edges: list[int]) -> Column:
    """How many of the edges, which descend, are above the key: those of every step first, then those of one step."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    whole = F.array(*map(F.lit, edges))
    coarse = F.size(F.filter(F.array(*map(F.lit, edges[::step])), lambda e: key < e))
    base = F.greatest(coarse - 1, F.lit(0)) * step
    return base + F.size(F.filter(F.slice(whole, base + 1, F.lit(step)), lambda e: key < e))


def with_next(docs: DataFrame, each, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Run `each(rows, next)` over (doc_id, text) in descending order of doc_id, where next closes the range."""
    spark = docs.sparkSession
    least = F.lit(-(1 << 63))
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), least))
    count = min(MAX_RANGES, max(1, math.ceil(C.total_bytes(docs) / range_bytes)))
    edges, firsts = _ranges(docs, F.col("__key"), count)
    if not firsts:
        return spark.createDataFrame([], schema)
    before = F.broadcast(spark.createDataFrame([(k, b) for k, _, b in firsts], "__key long, __before int"))  # one row per range
    own = F.struct(_range_of(F.col("__key"), edges).alias("r"), F.lit(False).alias("border"))
    to = F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__before").alias("r"), F.lit(True).alias("border"))))
    rows = docs.join(before, "__key", "left").select("doc_id", "text", "__key", F.explode(to).alias("to")).select("doc_id", "text", "__key", "to.*")
    placed = rows.repartitionById(len(edges) + 1, F.col("r")).sortWithinPartitions("border", F.desc("__key"), "text")
    return placed.select("doc_id", "text", "border").mapInArrow(each, schema)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents` and their edited texts."""
    docs = C.table(spark, folder, "documents").select("doc_id", C.text_or_empty().alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(ids: list, texts: list[str], ids_type) -> pa.RecordBatch:
        """Rows of all texts but the last, which is only a successor."""
        edited = []
        for own, after in zip(texts, texts[1:], strict=False):
            half = len(own) // 2
            edited.append((own[: len(own) - half] + after[:half]).encode())
        plain, changed = sketches([t.encode() for t in texts]), sketches(edited)
        n = len(edited)
        return pa.record_batch([
            pa.array(ids[:n], ids_type), pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([to_hex(s) for s in plain[:n]], pa.string()), pa.array([to_hex(s) for s in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(plain, changed, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(plain, plain[1:], strict=False)], pa.float64()),
        ], names=names)

    def each(batches):
        ids, texts, kind, closed = [], [], None, False
        for batch in C.slices(batches):
            kind = batch.schema.field("doc_id").type
            border = batch.column(2).to_pylist()
            n = border.index(True) if True in border else len(border)
            ids += batch.column(0).to_pylist()[:n]
            texts += batch.column(1).to_pylist()[:n]
            if n < len(border) and not closed:  # the first row of the next range
                closed = True
                if texts:
                    yield made(ids, [*texts, batch.column(1)[n].as_py()], kind)
            elif not closed and len(texts) > 1:
                yield made(ids, texts, kind)
                ids, texts = ids[-1:], texts[-1:]

    return with_next(docs, each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
