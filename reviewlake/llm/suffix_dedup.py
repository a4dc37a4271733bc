"""Suffix-array dedup: bytes covered by a long string that starts more than once in the corpus.

A difference-cover suffix sort in four steps, run on strings of `length` bytes:

1. *Sampled suffixes.* A sample of all suffixes such that any two equal strings hold sampled positions at the same
   offset. Positions mod 3 give that for triples; here the sample is chosen by content (the least fingerprint of each
   window of length/3 bytes), so partners meet at one offset and one position in about 64 is enough.
2. *Names.* A sampled suffix is named by its next 2/3 length bytes (inner name), then by the widest string around it
   that all starts sampled by it reach (outer name). Equal names are adjacent after the sort: a class of one inner name
   has no partner, a class of one repeated outer name is wholly repeated.
3. *Remaining suffixes.* Only where a class holds several outer names are its other suffixes named one by one, once per
   distinct outer name, and merged.
4. *Adjacent prefixes.* A suffix whose `length`-byte prefix equals a neighbour's is repeated; the bytes of its prefix go.

Names are 64-bit fingerprints instead of ranks, so naming needs no global sort: Spark shuffles them by value to shards,
and each shard sorts what it holds. Every document block sends each distinct name once, so a passage of a third of all
documents is one entry per block. Texts are shuffled once, into blocks of a few megabytes.

Null text is empty and stays empty; texts shorter than `length` keep all bytes; equal texts (repeated rows too) remove
each other; an empty table gives an empty result. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm import common as C

LENGTH = 400
STEP = 1 << 20
ENTRIES_PER_SHARD = 1 << 20
NAMES = "shard int, __block long, kind int, names binary, more binary"
REPLY = "__block long, shard int, kind int, reply binary"
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")
NONE, ALL, ALL_AND_SPEAKS, OPEN = range(4)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` keys, by start."""
    got, reach = keys, 1
    while 2 * reach <= width:
        got = np.minimum(got[:-reach], got[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def sampled(data: np.ndarray, offsets: np.ndarray, length: int):
    """Per slice of the block: (place of the slice, its fingerprints, first and last start of each run of starts that
    share a sampled position, inner name, outer name)."""
    width = max(1, min(128, length // 3))
    gram = max(1, min(16, length - width))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    stop_at = 0
    while stop_at < len(data):
        at, border = stop_at, int(offsets[np.searchsorted(offsets, stop_at + STEP, "right") - 1])
        # Whole documents, or a piece of one cut at a multiple of STEP from its start: runs do not depend on the order of rows.
        stop_at = border if border > at else min(at + STEP, len(data))
        part = data[at : stop_at + 2 * length]
        n_starts = min(stop_at - at, len(part) - length + 1)
        if n_starts <= 0:
            continue
        starts = np.arange(n_starts)
        fits = starts + length <= ends[at : at + n_starts] - at
        if not fits.any():
            continue
        marks = C.Rolling(part)
        keys = (marks.grams(gram) & ~C.U64((1 << 22) - 1)) | np.arange(len(part) - gram + 1, dtype=C.U64)
        anchor = (_least(keys, width)[:n_starts] & C.U64((1 << 22) - 1)).astype(np.int64)
        new = np.empty(n_starts, bool)
        new[0] = True
        # Another anchor, a start that does not fit before, or another document begins a run.
        new[1:] = (anchor[1:] != anchor[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new & fits)
        stop = np.append(np.flatnonzero(new | ~fits), n_starts)
        last = stop[np.searchsorted(stop, first, "right")] - 1
        inner = anchor[first]
        yield at, marks, first, last, marks.names(inner, inner + length - width), marks.names(first, last + length)


def _pairs(data: np.ndarray, offsets: np.ndarray, length: int):
    """All runs of a block as (starts, ends) and their distinct (inner, outer) names in order; `of` maps runs to them."""
    found = [(at + f, at + la, i, o) for at, _, f, la, i, o in sampled(data, offsets, length)]
    first, last, inner, outer = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64 if j < 2 else C.U64) for j in range(4))
    order = np.lexsort((outer, inner))
    i, o = inner[order], outer[order]
    head = np.ones(len(order), bool)
    head[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(head) - 1
    return first, last, i[head], o[head], np.diff(np.append(np.flatnonzero(head), len(order))), of, order[head]


def _payload(block: int, kind: int, names: np.ndarray, more: list[np.ndarray], shards: int) -> list[tuple]:
    return [(s, block, kind, names[a:b].tobytes(), b"".join(m[a:b].tobytes() for m in more)) for s, a, b in C.shard_runs(names, shards)]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_NAMES = pa.schema([("shard", pa.int32()), (C.BLOCK, pa.int64()), ("kind", pa.int32()), ("names", pa.binary()), ("more", pa.binary())])
_REPLY = pa.schema([(C.BLOCK, pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("reply", pa.binary())])


def _replies(table: pa.Table, kind: int, size: int) -> np.ndarray:
    """A block's replies of one kind, joined in the order of the names."""
    got = sorted((s, r) for s, k, r in zip(table["shard"].to_pylist(), table["kind"].to_pylist(), table["reply"].to_pylist(), strict=True) if k == kind)
    out = np.frombuffer(b"".join(r for _, r in got), np.uint8)
    assert len(out) == size, "replies do not match the names of the block"
    return out


def _sort_classes(table: pa.Table) -> pa.Table:
    """One shard: for each block's (inner, outer) names, what the classes say."""
    blocks = table[C.BLOCK].to_numpy()
    shard = table["shard"][0].as_py()
    inner = [np.frombuffer(x, C.U64) for x in table["names"].to_pylist()]
    sizes = np.array([len(x) for x in inner])
    more = table["more"].to_pylist()
    outer = np.concatenate([np.frombuffer(x, C.U64, n) for x, n in zip(more, sizes, strict=True)])
    times = np.concatenate([np.frombuffer(x, np.uint8, n, 8 * n) for x, n in zip(more, sizes, strict=True)]).astype(np.int64)
    inner = np.concatenate(inner)
    block = np.repeat(blocks, sizes)
    order = np.lexsort((block, outer, inner))
    i, o, t = inner[order], outer[order], times[order]
    new_i = np.ones(len(i), bool)
    new_i[1:] = i[1:] != i[:-1]
    new_o = new_i.copy()
    new_o[1:] |= o[1:] != o[:-1]
    at_i, at_o = np.flatnonzero(new_i), np.flatnonzero(new_o)
    of_i, of_o = np.cumsum(new_i) - 1, np.cumsum(new_o) - 1
    n_i, n_o = np.add.reduceat(t, at_i)[of_i], np.add.reduceat(t, at_o)[of_o]
    kinds = np.add.reduceat(new_o.astype(np.int64), at_i)[of_i]
    state = np.where(n_i < 2, NONE, np.where(n_o < 2, OPEN, np.where((kinds > 1) & new_o, ALL_AND_SPEAKS, ALL))).astype(np.uint8)
    back = np.empty_like(state)
    back[order] = state
    cuts = np.cumsum(sizes)[:-1]
    return _rows([(int(b), shard, 0, x.tobytes()) for b, x in zip(blocks, np.split(back, cuts), strict=True)], _REPLY)


def _count_prefixes(table: pa.Table) -> pa.Table:
    """One shard: which of each block's names of single suffixes start more than once."""
    blocks = table[C.BLOCK].to_numpy()
    shard = table["shard"][0].as_py()
    parts = [np.frombuffer(x, C.U64) for x in table["names"].to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in table["more"].to_pylist()])
    names, of = np.unique(np.concatenate(parts), return_inverse=True)
    again = (np.bincount(of, times, len(names)) >= 2)[of].astype(np.uint8)
    cuts = np.cumsum([len(x) for x in parts])[:-1]
    return _rows([(int(b), shard, 1, x.tobytes()) for b, x in zip(blocks, np.split(again, cuts), strict=True)], _REPLY)


def _single(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the given runs and the names of their prefixes."""
    n = last - first + 1
    starts = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    names = np.empty(len(starts), C.U64)
    for at in range(0, len(data), STEP):
        here = (starts >= at) & (starts < at + STEP)
        if here.any():
            local = starts[here] - at
            names[here] = C.Rolling(data[at : at + STEP + length]).names(local, local + length)
    return starts, names


def _open_runs(data, offsets, length, reply):
    """Starts whose prefixes must be compared one by one, whether they wait for an answer, and the wholly repeated runs."""
    first, last, inner, _, _, of, sample = _pairs(data, offsets, length)
    state = _replies(reply, 0, len(inner))
    mine = state[of] if len(of) else np.zeros(0, np.uint8)
    speaks = np.zeros(len(first), bool)
    speaks[sample[state == ALL_AND_SPEAKS]] = True
    asks = mine == OPEN
    pick = asks | speaks
    starts, names = _single(data, first[pick], last[pick], length)
    waits = np.repeat(asks[pick], last[pick] - first[pick] + 1)
    whole = (mine == ALL) | (mine == ALL_AND_SPEAKS)
    return starts, names, waits, first[whole], last[whole]


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """All columns of `docs` with n_bytes, n_removed, n_spans, kept_sha256, kept_text and spans (removed byte ranges).

    kept_text is the kept bytes as text, without the rest of characters that a range cuts.
    """
    docs = docs.drop(*[c for c in RESULTS if c not in (id_column, text)])
    blocks = C.block_count(docs, text, block_bytes)
    dealt = C.blocked(docs, blocks, id_column, text)
    shards = 1 << max(3, math.ceil(math.log2(max(1, blocks * block_bytes / 64 / ENTRIES_PER_SHARD))))

    def name_classes(table: pa.Table) -> pa.Table:
        data, offsets = C.byte_view(table[text])
        _, _, inner, outer, times, _, _ = _pairs(data, offsets, length)
        return _rows(_payload(table[C.BLOCK][0].as_py(), 0, inner, [outer, np.minimum(times, 2).astype(np.uint8)], shards), _NAMES)

    def name_single(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], _NAMES)
        data, offsets = C.byte_view(table[text])
        _, names, _, _, _ = _open_runs(data, offsets, length, reply)
        names, times = np.unique(names, return_counts=True)
        return _rows(_payload(table[C.BLOCK][0].as_py(), 1, names, [np.minimum(times, 2).astype(np.uint8)], shards), _NAMES)

    passed = [f for f in docs.schema.fields]
    schema = T.StructType([*passed, *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:long,stop:long>>").fields])

    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        data, offsets = C.byte_view(table[text])
        covered = np.zeros(len(data), bool)
        if table.num_rows:
            starts, names, waits, first, last = _open_runs(data, offsets, length, reply)
            distinct, of = np.unique(names, return_inverse=True)
            again = _replies(reply, 1, len(distinct))[of].astype(bool) & waits if len(of) else waits
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, np.concatenate([first, starts[again]]), 1)
            np.add.at(depth, np.concatenate([last, starts[again]]) + length, -1)
            covered = np.cumsum(depth[:-1]) > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        inner_first = offsets[:-1][np.diff(offsets) > 0]
        opens[inner_first] = covered[inner_first]
        begin = np.flatnonzero(opens)
        edge = np.ones(len(data) + 1, bool)
        edge[:-1] = ~covered
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        end = edges[np.searchsorted(edges, begin, "right")]
        removed = np.append(0, np.cumsum(covered))[offsets]
        cuts = np.searchsorted(begin, offsets)
        kept, kept_at = data[~covered], offsets - removed
        raw = kept.tobytes()
        digests, texts, spans = [], [], []
        for j in range(table.num_rows):
            piece = raw[kept_at[j] : kept_at[j + 1]]
            digests.append(hashlib.sha256(piece).hexdigest())
            texts.append(piece.decode("utf-8", "ignore"))
            spans.append([{"start": int(b - offsets[j]), "stop": int(e - offsets[j])} for b, e in zip(begin[cuts[j] : cuts[j + 1]], end[cuts[j] : cuts[j + 1]], strict=True)])
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        new = [pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(cuts).astype(np.int64)), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(spans, span_type)]
        return pa.table([table[f.name] for f in passed] + new, names=[f.name for f in schema.fields])

    slim = dealt.select(*[f"`{f.name}`" for f in passed], C.BLOCK)
    entries = slim.groupBy(C.BLOCK).applyInArrow(name_classes, NAMES)
    classes = entries.groupBy("shard").applyInArrow(_sort_classes, REPLY)
    singles = slim.groupBy(C.BLOCK).cogroup(classes.groupBy(C.BLOCK)).applyInArrow(name_single, NAMES)
    prefixes = singles.groupBy("shard").applyInArrow(_count_prefixes, REPLY)
    return slim.groupBy(C.BLOCK).cogroup(classes.unionByName(prefixes).groupBy(C.BLOCK)).applyInArrow(cut, schema)


#: Bytes of a repeat worth a mark beside the contract's: every passage of over 50 words of four letters and a blank has them.
PASSAGE = 250


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents`, strings of 400 bytes; n_passage_bytes is what strings of `PASSAGE` bytes would remove."""
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    same = F.sha2(F.col("text"), 256).alias("__same")  # rows of equal id and text have equal results
    cut = suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", same)
    marks = suffix_dedup(docs, length=PASSAGE).select(F.col("doc_id").alias("__id"), same.alias("__text"), "n_removed")
    marks = marks.groupBy("__id", "__text").agg(F.max("n_removed").alias("n_passage_bytes"))
    joined = cut.join(marks, cut["doc_id"].eqNullSafe(marks["__id"]) & (cut["__same"] == marks["__text"]), "left")
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
