"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become pieces of at most `capacity` tokens. How many pieces have each length is a histogram of at most
`capacity` numbers; the driver needs nothing else. Patterns of one to four lengths that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares (cyclic coordinate descent) and
rounded down; the rest is packed by best fit: the longest length left, completed exactly by one or two lengths where
that is possible, else by the longest that fits, as many times as the counts allow. The work depends on the number of
distinct lengths, not of documents.

A plan says which ranks of a length take which place of which sequence. Pieces get their rank within their length from
one small count per (length, bucket), so no length is sorted in one task, and find their place by bisection of the plan.

Null text is empty: one piece that holds the end id alone. Equal rows get places of their own. Other columns are dropped;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C
from reviewlake.llm import token_ids
from reviewlake.llm.sharding import with_slots

CAPACITY = 2048
END_ID = 0
SWEEPS = 30
GRID = 48


def pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Of a longer document the first piece is the short one."""
    path = path or token_ids.default_path()

    def each(batches):
        for batch in C.slices(batches):
            rows: list[tuple] = []
            for j, body in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*token_ids.encode(path, body)[0], END_ID], "<u4")
                stops = np.arange((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops.tolist()):
                    rows.append((j, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            of, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.record_batch([
                batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())
            ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_column).alias("doc_id"), C.text_or_empty(text).alias("text"))
    return slim.mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_column]}, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(have: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Full patterns of one to four lengths that occur; of those of three and four, the ones whose shorter lengths lie on a grid."""
    present = [int(x) for x in np.flatnonzero(have)]
    out: list[tuple[int, ...]] = [(capacity,)] if have[capacity] else []
    out += [(capacity - a, a) for a in present if a <= capacity - a and have[capacity - a]]
    short = [a for a in present if a <= capacity // 2]
    grid = short[:: max(1, len(short) // GRID)]
    for i, a in enumerate(grid):
        for b in short:
            c = capacity - a - b
            if c >= b >= a and have[c]:
                out.append((c, b, a))
        for b in grid[i:]:
            for c in grid:
                d = capacity - a - b - c
                if d >= c >= b and have[d]:
                    out.append((d, c, b, a))
    return out


def fit_counts(patterns: list[tuple[int, ...]], have: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 with least squared distance between the lengths the patterns use and those there are."""
    rest = have.astype(float).tolist()
    counts = [0.0] * len(patterns)
    uses = [(sorted(set(p)), [p.count(v) for v in sorted(set(p))]) for p in patterns]
    uses = [(values, times, float(sum(t * t for t in times))) for values, times in uses]
    for _ in range(sweeps):
        for j, (values, times, norm) in enumerate(uses):
            slope = 0.0
            for v, t in zip(values, times, strict=True):
                slope += rest[v] * t
            step = max(-counts[j], slope / norm)
            if step:
                counts[j] += step
                for v, t in zip(values, times, strict=True):
                    rest[v] -= step * t
    return np.array(counts)


def _complete(left: np.ndarray, space: int) -> list[int]:
    """Lengths that fill `space` best: exactly by one or two, else the longest that fits, and so on."""
    taken: list[int] = []
    left = left.copy()
    while space:
        if left[space]:
            return [*taken, space]
        if space > 1:
            fit = (left[1:space] > 0) & (left[space - 1 : 0 : -1] > 0)
            if space % 2 == 0 and left[space // 2] < 2:
                fit[space // 2 - 1] = False
            at = np.flatnonzero(fit)
            if len(at):
                return [*taken, int(at[-1]) + 1, space - int(at[-1]) - 1]
        at = np.flatnonzero(left[1 : space + 1])
        if not len(at):
            return taken
        longest = int(at[-1]) + 1
        taken.append(longest)
        left[longest] -= 1
        space -= longest
    return taken


def plan(have: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use every length exactly as often as it occurs."""
    left = have.astype(np.int64).copy()
    used: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        values, each = np.unique(pattern, return_counts=True)
        times = min(times, int((left[values] // each).min()))
        if times > 0:
            left[values] -= times * each
            used.append((pattern, times))

    patterns = enumerate_patterns(have, capacity)
    counts = np.floor(fit_counts(patterns, have)).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 1:
            break
        take(patterns[j], int(counts[j]))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        rest = _complete(left, capacity - longest)
        left[longest] += 1
        take((longest, *rest), 1 << 62)
    return used


def places(used: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, first sequence, offset) of each run of ranks, in order of length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in used:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; `cut` is read twice, so write it out first."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        have[length] = n
    rows = places(plan(have, capacity))
    keys = (rows[:, 0] << 44) | rows[:, 1]

    def each(batches):
        for batch in batches:
            got = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "slot")}
            at = np.searchsorted(keys, (got["length"] << 44) | got["slot"], "right") - 1
            found = rows[at]
            sequence = found[:, 2] + got["slot"] - found[:, 1]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(found[:, 3])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = with_slots(cut, "length", ["doc_id", "piece", "start", "ids_crc32"])
    schema = ", ".join(f"`{n}` {k}" for n, k in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(each, schema)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents` in sequences of 2048 tokens."""
    return pack(C.settled(pieces(C.table(spark, folder, "documents")), "pieces"))
