"""Benchmark decontamination by SimHash windows, Hamming blocks and exact weighted similarity.

Items and texts are rows of words (lower-cased A-Z, split at white space) and of their five-word shingles; a shorter item is
one shingle. A shingle weighs ln(1 + items / items that hold it). A text is contaminated by an item if one of its windows of
as many words as the item has a weighted Jaccard similarity of THRESHOLD or more to it.

1. Such a window shares shingles of at least THRESHOLD of the item's weight, so only items whose shingles in the text weigh
   that much are looked at, and only windows over those shingles. Nothing that counts is left out.
2. Every such window gets a SimHash of BITS bits from running sums of the weighted bits of its distinct shingles.
3. Multi-index blocks: a fingerprint within RADIUS of the item's agrees with it up to RADIUS / BLOCKS bits in at least one
   block (pigeonhole), so windows that fail in all blocks, then those beyond RADIUS, are dropped. Similarity 0.8 gives
   39 differing bits of 256 on average, with a deviation of 6; RADIUS leaves seven of them.
4. The rest is verified exactly. The best window of each document and item is returned.

Texts are scanned in place, without a shuffle; windows are summed up STEP words at a time, so memory does not grow with the
distance between the hits of an item. Items come to the tasks in chunks of at most CHUNK_SHINGLES shingles; a
larger benchmark takes more than one scan, each with items of a bounded size.

Items of fewer than WORDS words are looked up among all windows of as many words of every text.

Null and empty texts and items without words match nothing. A text shorter than an item is one window. Equal texts match
equally, equal items each match. Repeated item ids count as items of their own. An empty documents or benchmark table
gives no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

WORDS, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 16, 80
CHUNK_SHINGLES = 1 << 20
STEP = 4096
SIEVE_BITS = 22
_PLANES = C.splitmix(np.arange(1, BITS // 64 + 1, dtype=C.U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_rows(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Shingle names by place of their first word, the document of each word, and whether a shingle begins there."""
    data = _LOWER[data]
    starts, ends, doc = C.word_spans(data, offsets)
    name = C.span_names(data, starts, ends)
    n = len(name)
    out, valid = np.zeros(n, C.U64), np.zeros(n, bool)
    size = np.bincount(doc, minlength=len(offsets) - 1)
    for k in range(1, words + 1):
        if n < k:
            break
        first = np.arange(n - k + 1)
        keep = doc[k - 1 :] == doc[: n - k + 1]
        if k < words:
            keep &= size[doc[first]] == k
        at = first[keep]
        if not len(at):
            continue
        out[at], valid[at] = _mixed(name, at, k), True
    return out, doc, valid


def _mixed(name: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Names of the shingles of `k` words from each place on."""
    mixed = np.full(len(at), C.U64(k))
    for j in range(k):
        mixed = C.splitmix(mixed + name[at + j])
    return mixed


def short_matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, float]]:
    """(document, item, first word, 1.0) of the first place where a text holds an item of fewer than WORDS words."""
    data = _LOWER[data]
    starts, ends, doc = C.word_spans(data, offsets)
    name = C.span_names(data, starts, ends)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    size = np.array(items.words)
    for k in np.unique(size[size < WORDS]).tolist():
        at = np.flatnonzero(doc[k - 1 :] == doc[: max(0, len(doc) - k + 1)])
        place, item = items.hits(_mixed(name, at, k), np.ones(len(at), bool))
        own = size[item] == k
        place, item = at[place[own]], item[own]
        _, least = np.unique(doc[place] * len(size) + item, return_index=True)  # places of an item ascend
        for p, j in zip(place[least].tolist(), item[least].tolist(), strict=True):
            yield int(doc[p]), j, int(p - first[doc[p]]), 1.0


def _bits(names: np.ndarray) -> np.ndarray:
    """BITS signs of each name."""
    words = C.splitmix((names[:, None] + _PLANES[None, :]).ravel()).reshape(len(names), -1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


class Items:
    """A bounded chunk of items, ready for lookups."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.words = [r["words"] for r in rows]
        self.weight = [dict(zip(r["names"], r["weights"], strict=True)) for r in rows]
        self.total = [sum(w.values()) for w in self.weight]
        pairs = sorted((x, j) for j, w in enumerate(self.weight) for x in w)
        self.names = np.array([x for x, _ in pairs], np.int64).astype(C.U64)
        self.owner = np.array([j for _, j in pairs], np.int64)
        order = np.argsort(self.names, kind="stable")
        self.names, self.owner = self.names[order], self.owner[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.names >> C.U64(64 - SIEVE_BITS)] = True
        self.marks = []
        for w in self.weight:
            sums = (_bits(np.array(list(w), np.int64).astype(C.U64)) * np.array(list(w.values()), np.float32)[:, None]).sum(0)
            self.marks.append(np.packbits(sums > 0))

    def hits(self, names: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that items hold, once per item, and the items."""
        at = np.flatnonzero(valid & self.sieve[names >> C.U64(64 - SIEVE_BITS)]) if len(self.names) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.names, names[at]), np.searchsorted(self.names, names[at], "right")
        n = hi - lo
        return np.repeat(at, n), self.owner[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]


def _windows(places: np.ndarray, words: int, size: int) -> np.ndarray:
    """Starts of the windows of `words` words of a text of `size` words that hold a shingle of one of the places."""
    last = max(0, size - words)
    lo, hi = np.clip(places - words + 1, 0, last), np.clip(places, 0, last)
    marks = np.zeros(last + 2, np.int64)
    np.add.at(marks, lo, 1)
    np.add.at(marks, hi + 1, -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def _window_sums(names: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Weighted bits of the distinct names of the `width` places from each place on."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    again = np.flatnonzero(names[order][1:] == names[order][:-1])
    since = np.zeros(n, np.int64)  # the first window that does not hold an earlier place of the same name
    since[order[again + 1]] = order[again] + 1
    own, at = _bits(names) * weights[:, None], np.arange(n)
    sums = np.zeros((n + 1, BITS), np.float32)
    np.negative(own, out=sums[1:])
    enter = at - width + 1
    repeated = since > np.maximum(enter, 0)
    sums[since[repeated]] += own[repeated]
    later = ~repeated & (enter > 0)
    sums[enter[later]] += own[later]
    sums[0] += own[~repeated & (enter <= 0)].sum(0)
    return np.cumsum(sums, axis=0, out=sums)


def near_windows(names: np.ndarray, valid: np.ndarray, starts: np.ndarray, item: int, items: Items, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows within a stretch of a text: whether each one's fingerprint is near the item's, its end, the weights from the first start on."""
    words, own = items.words[item], items.weight[item]
    lo = int(starts[0])
    part, ok = names[lo : int(starts[-1]) + words], valid[lo : int(starts[-1]) + words]
    weights = np.array([own.get(x, other) for x in part.astype(np.int64).tolist()], np.float32) * ok
    width = max(1, words - min(WORDS, words, len(names)) + 1)
    marks = np.packbits(_window_sums(part, weights, width)[starts - lo] > 0, axis=1) ^ items.marks[item]
    blocks = np.bitwise_count(marks).reshape(len(starts), BLOCKS, -1).sum(2, dtype=np.int64)
    return (blocks.min(1) <= RADIUS // BLOCKS) & (blocks.sum(1) <= RADIUS), np.minimum(starts + width, lo + len(part)), weights


def best_window(names: np.ndarray, valid: np.ndarray, places: np.ndarray, item: int, items: Items, other: float, threshold: float) -> tuple[int, float] | None:
    """Start and similarity of the best window of one text for one item; `other` weighs shingles that no item holds."""
    own = items.weight[item]
    starts = _windows(places, items.words[item], len(names))
    best = None
    for some in np.split(starts, np.flatnonzero(np.diff(starts // STEP)) + 1):
        near, ends, weights = near_windows(names, valid, some, item, items, other)
        lo = int(some[0])
        for start, end in zip(some[near].tolist(), ends[near].tolist(), strict=True):
            ok = valid[start:end]
            window = dict(zip(names[start:end][ok].astype(np.int64).tolist(), weights[start - lo : end - lo][ok].tolist(), strict=True))
            both = sum(own[x] for x in window if x in own)
            similarity = both / (items.total[item] + sum(own.get(x, w) for x, w in window.items()) - both)
            if similarity >= threshold - 1e-9 and (best is None or similarity > best[1] + 1e-12):
                best = (start, similarity)
    return best


def scan(data: np.ndarray, offsets: np.ndarray, items: Items, other: float, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(document, item, first word, similarity) of every match of a batch."""
    names, doc, valid = shingle_rows(data, offsets)
    at, item = items.hits(names, valid)
    if min(items.words, default=WORDS) < WORDS:
        yield from short_matches(data, offsets, items)
        long = np.array(items.words)[item] >= WORDS
        at, item = at[long], item[long]
    if not len(at):
        return
    first = np.searchsorted(doc, np.arange(len(offsets)))
    order = np.lexsort((at, item, doc[at]))
    at, item = at[order], item[order]
    key = doc[at] * len(items.ids) + item
    cuts = np.flatnonzero(np.append(True, np.diff(key) != 0))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        j, d = int(item[lo]), int(doc[at[lo]])
        have = sum(items.weight[j][x] for x in set(names[at[lo:hi]].astype(np.int64).tolist()))
        if have >= threshold * items.total[j] - 1e-9:
            a, b = first[d], first[d + 1]
            found = best_window(names[a:b], valid[a:b], at[lo:hi] - a, j, items, other, threshold)
            if found:
                yield d, j, *found


def item_chunks(benchmark: DataFrame, chunk: int = CHUNK_SHINGLES) -> Iterator[tuple[Items, float]]:
    """Items in chunks of about `chunk` shingles, and the weight of a shingle that no item holds."""

    def each(batches):
        for batch in C.slices(batches):
            data, offsets = C.byte_view(batch.column(1))
            names, doc, valid = shingle_rows(data, offsets)
            words = np.bincount(doc, minlength=batch.num_rows)
            at = np.flatnonzero(valid)
            yield pa.record_batch([
                batch.column(0).take(pa.array(doc[at])), batch.column(2).take(pa.array(doc[at])), pa.array(words[doc[at]].astype(np.int32)), pa.array(names[at].astype(np.int64))
            ], names=["item_id", "row", "words", "name"])

    kind = dict(benchmark.dtypes)["item_id"]
    # Rows are numbered once and written out, so that equal items stay apart and every reading sees the same numbers.
    numbered = C.settled(benchmark.select("item_id", C.text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    rows = C.settled(numbered.mapInArrow(each, f"item_id {kind}, row long, words int, name long").distinct(), "item_shingles")
    shingles, items = rows.agg(F.count(F.lit(1)), F.countDistinct("row")).first()
    if not shingles:
        return
    weighed = rows.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").withColumn("weight", F.log1p(F.lit(float(items)) / F.col("n")))
    whole = weighed.groupBy("row", "item_id", "words").agg(F.sort_array(F.collect_list(F.struct("name", "weight"))).alias("s"))
    whole = C.settled(whole.select("row", "item_id", "words", F.col("s.name").alias("names"), F.col("s.weight").alias("weights")), "weighed_items")
    count = math.ceil(shingles / chunk)
    for k in range(count):
        mine = whole.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == k).orderBy("row").collect()  # about `chunk` shingles
        yield Items(mine), math.log1p(items)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word), words, similarity: the best window of every contaminated document and item."""
    slim = docs.select("doc_id", C.text_or_empty().alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, start int, words int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for items, other in item_chunks(benchmark):

        def each(batches, items=items, other=other):
            for batch in C.slices(batches):
                found = list(scan(*C.byte_view(batch.column(1)), items, other, threshold))
                if found:
                    d, j, start, similarity = zip(*found, strict=True)
                    yield pa.record_batch([
                        batch.column(0).take(pa.array(d, pa.int64())), pa.array([items.ids[x] for x in j]), pa.array(start, pa.int32()), pa.array([items.words[x] for x in j], pa.int32()), pa.array(similarity, pa.float64())
                    ], names=["doc_id", "item_id", "start", "words", "similarity"])

        out = out.unionByName(slim.mapInArrow(each, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that no item contaminates."""
    out = docs
    for items, other in item_chunks(benchmark):

        def each(batches, items=items, other=other):
            for batch in C.slices(batches, text):
                column = batch.column(batch.schema.get_field_index(text))
                bad = np.zeros(batch.num_rows, bool)
                for d, *_ in scan(*C.byte_view(column), items, other, threshold):
                    bad[d] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(each, docs.schema)
    return out


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents` against the whole `benchmark`."""
    return matches(C.table(spark, folder, "documents"), C.table(spark, folder, "benchmark"))
