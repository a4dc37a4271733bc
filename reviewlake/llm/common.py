"""Shared parts: null-safe inputs, blocks of documents, byte views of Arrow text, fingerprints of byte ranges."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import settled  # noqa: F401  used by the operators

BLOCK_BYTES = 4 << 20
BLOCK = "__block"
U64 = np.uint64


def shipped(spark: SparkSession) -> SparkSession:
    """Let the Python workers of a local session import this package from wherever the driver has it.

    On a cluster the package comes with --py-files or the cluster's image, as any library does.
    """
    if spark.sparkContext.master.startswith("local["):
        spark.sparkContext.addFile(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), recursive=True)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def in_part(id_column: str, modulus: int, remainder: int):
    """crc32 of the id as text, mod `modulus`, equals `remainder`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about `block_bytes` of text each, so that one block fits in a task at any size of the corpus."""
    return max(1, math.ceil(total_bytes(docs, text) / block_bytes))


def blocked(docs: DataFrame, count: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with null text as empty, dealt to `count` blocks by a hash of id and text."""
    return docs.withColumns({text: text_or_empty(text), BLOCK: F.pmod(F.xxhash64(F.col(id_column), F.col(text)), F.lit(count))})


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, one document after the other, and len+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text, or a single longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Multiplier of the rolling fingerprint, odd and 5 mod 8, and its inverse mod 2**64.
BASE = 0x2545F4914F6CDD1D
_CODES = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got[:n]


def shard_runs(names: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, end) of the runs of sorted names by their highest bits; `shards` is a power of two."""
    if not len(names):
        return []
    of = names >> U64(65 - shards.bit_length()) if shards > 1 else np.zeros(len(names), U64)
    cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(names)]])
    return [(int(of[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


class Rolling:
    """Fingerprints of any byte range of `data`, from prefix sums of code * BASE**i mod 2**64."""

    def __init__(self, data: np.ndarray, codes: np.ndarray | None = None):
        n = len(data)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((_CODES if codes is None else codes)[data] * powers(n), out=self.prefix[1:])
        self.inverse = powers(n + 1, pow(BASE, -1, 1 << 64))

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit names; ranges of other lengths get other names."""
        return splitmix(self.raw(starts, ends) + (np.asarray(ends) - np.asarray(starts)).astype(U64) * U64(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> np.ndarray:
        """Mixed fingerprints of every k-byte string, by start."""
        n = len(self.prefix) - 1
        return splitmix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.inverse[: n + 1 - k]) if n >= k else np.zeros(0, U64)


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """`Rolling.names` of sorted spans that do not overlap, `step` bytes of data at a time to bound memory."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, at + step)))
        out[lo:hi] = Rolling(data[at : int(ends[hi - 1])]).names(starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of the maximal runs of bytes marked `inside`; a document's border ends a run."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # also of an empty document: its place holds another one's first byte or the end
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(begins)
    stops = np.ones(n + 1, bool)
    stops[:n] = ~inside | first[:n]
    marks = np.flatnonzero(stops)
    ends = marks[np.searchsorted(marks, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and \\t..\\r."""
    return runs((data != 32) & ((data < 9) | (data > 13)), offsets)
