"""Counts of a fixed vocabulary's words, word pairs and triples, in Arrow batches.

The same vectors as a tokenizer, n-grams and a count vectorizer give one after the other, without a string for each pair and
triple: words are looked up in the vocabulary's own words, and pairs and triples by the numbers of their words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.session import ship_package

STEP = 4 << 20  # bytes of text taken apart at once
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    part = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""All matches of \w\w+ (ASCII) in large binary texts without nulls, and the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _WORD[data]
    before, after, border = np.zeros((3, len(data) + 1), bool)
    before[1:], after[:-1], border[offsets] = inside, inside, True
    starts = np.flatnonzero(after & (~before | border))
    ends = np.flatnonzero(before & (~after | border))
    long = ends - starts > 1
    inside[starts[~long]] = False  # single letters
    starts, ends = starts[long], ends[long]
    bounds = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return words, np.searchsorted(offsets, starts, "right") - 1


class Terms:
    """Places of terms of one to three words in a vocabulary."""

    def __init__(self, vocabulary: Sequence[str]):
        parts = [t.split(" ") for t in vocabulary]
        self.size = len(parts)
        self.words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        self.tables = []
        for n in (1, 2, 3):
            rows = sorted((self.key([number[w] for w in p]), i) for i, p in enumerate(parts) if len(p) == n)
            self.tables.append(np.array(rows, np.int64).reshape(-1, 2).T)

    def key(self, numbers):
        out = numbers[0]
        for x in numbers[1:]:
            out = out * len(self.words) + x
        return out

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and count of each term that occurs, by text and place."""
        words, of = words_of(texts)
        number = pc.index_in(words, value_set=pa.array([w.encode() for w in self.words], pa.large_binary())).fill_null(-1).to_numpy().astype(np.int64)
        found = []
        for n, (keys, places) in enumerate(self.tables):
            many = max(0, len(number) - n)
            runs = [number[i : i + many] for i in range(n + 1)]
            at = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in runs]) & (of[:many] == of[n : n + many]))
            if not len(keys) or not len(at):
                continue
            asked = self.key([x[at] for x in runs])
            near = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[near] == asked
            found.append(of[at[hit]] * self.size + places[near[hit]])
        terms, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        return terms // self.size, terms % self.size, n


def with_counts(df: DataFrame, text: str, vocabulary: Sequence[str], name: str = "counts") -> DataFrame:
    """`df` with the vector of counts in place of the text; a null text has no terms."""
    ship_package(df.sparkSession)
    terms, others = Terms(vocabulary), [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(name, VectorUDT())])

    def vectors(texts: pa.Array) -> pa.Array:
        of, places, counts = terms.counts(texts)
        bounds = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), terms.size, np.int32)),
                pa.ListArray.from_arrays(bounds, pa.array(places.astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(counts.astype(float))),
            ],
            names=["type", "size", "indices", "values"],
        )

    def each(batches):
        for batch in batches:
            texts, at = batch.column(len(others)).cast(pa.large_binary()).fill_null(b""), 0
            for part in _steps(texts):
                rows = batch.slice(at, len(part))
                at += len(part)
                yield pa.record_batch([*rows.columns[:-1], vectors(part)], names=[*others, name])

    return df.select(*others, F.lower(text).alias(text)).mapInArrow(each, schema)
