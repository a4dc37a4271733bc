"""Searches for many phrases or words at once, in Arrow batches of lower-case text.

A chain of `contains` reads a text once per phrase. Here a text is read once for all phrases: three bytes at every place
look up whether any phrase begins so, and only those places are compared further. Results are bits or counts; what they
mean is said by the operators, in Column expressions. Memory is bounded by a slice of STEP bytes, or by the longest text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors then need no copy of this package
STEP = 1 << 20
BITS = 60
PAD = 32
PRIME = np.uint32(0x9E3779B1)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the low k bytes


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes (with PAD zeros behind) and offsets of some rows at a time; null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        a, b = offsets[row], offsets[end]
        part = np.zeros(b - a + PAD, np.uint8)
        part[: b - a] = data[a:b]
        yield part, offsets[row : end + 1] - a
        row = end


def _view(data: np.ndarray, kind: str, shift: int = 0) -> np.ndarray:
    """The number that starts at each place, without a copy."""
    return np.ndarray((len(data) - PAD,), kind, data, shift, (1,))


def _cut(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 8], "little")


class Phrases:
    """Phrases by their first three bytes; `find` gives (phrase, row) of every occurrence."""

    def __init__(self, phrases: Sequence[str]):
        self.phrases = [p.encode() for p in phrases]
        if any(len(p) < 3 for p in self.phrases):
            raise ValueError("phrases of three bytes or more")
        heads = np.array([int.from_bytes(p[:3], "little") for p in self.phrases], np.uint32)
        slots, self.slot = np.unique((heads * PRIME) >> np.uint32(16), return_inverse=True)
        self.table = np.zeros(1 << 16, np.uint16)
        self.table[slots] = np.arange(1, len(slots) + 1)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        head = _view(data, "<u4") & np.uint32(0xFFFFFF)
        head *= PRIME
        head >>= np.uint32(16)
        slot = self.table[head]
        at = np.flatnonzero(slot)
        slot = slot[at]
        order = np.argsort(slot, kind="stable")
        at = at[order]
        ends = np.searchsorted(slot[order], np.arange(len(self.phrases) + 2))
        words = [_view(data, "<u8", k) for k in (0, 8, 16)]
        row_of = np.searchsorted(offsets, at, "right") - 1
        limit = offsets[row_of + 1]
        firsts = words[0][at]
        for i, (phrase, s) in enumerate(zip(self.phrases, self.slot + 1, strict=True)):
            a, b = ends[s], ends[s + 1]
            if a == b:
                continue
            n = len(phrase)
            same = (firsts[a:b] & _KEEP[min(n, 8)]) == np.uint64(_cut(phrase, 0))
            same &= at[a:b] + n <= limit[a:b]
            hit = np.flatnonzero(same) + a
            for k in range(8, n, 8):
                if not len(hit):
                    break
                later = words[k // 8][at[hit]] if k < 24 else np.array([_cut(data[x + k : x + k + 8].tobytes(), 0) for x in at[hit]], np.uint64)
                hit = hit[(later & _KEEP[min(n - k, 8)]) == np.uint64(_cut(phrase, k))]
            if len(hit):
                yield i, row_of[hit]


def _classes(data: np.ndarray, categories: str, also: bytes) -> np.ndarray:
    """Whether each byte (without the PAD) belongs to a character of the categories (first letters) or is one of `also`."""
    table = np.array([c in also or unicodedata.category(chr(c))[0] in categories for c in range(128)] + [False] * 128)
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        code, first = np.zeros(len(lead), np.int64), data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        more = [data[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            value = first & mask
            for k in range(n - 1):
                value = (value << 6) | more[k]
            code = np.where(size == n, value, code)
        codes, of = np.unique(code, return_inverse=True)
        known = np.array([c < 0x110000 and unicodedata.category(chr(c))[0] in categories for c in codes.tolist()])[of]
        for k in range(4):
            inside = k < size
            out[lead[inside] + k] = known[inside]
    return out[:-PAD]


def _runs(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of `inside` within a row; runs also begin at `cut`."""
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    if cut is not None:
        starts[cut] = inside[cut]
    s = np.flatnonzero(starts)
    return s, (np.add.reduceat(inside, s, dtype=np.int64) if len(s) else s)


def _rows(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


class Words:
    """Words of at most 16 bytes with a number each; `of` gives the number of every run, 0 for others."""

    def __init__(self, numbers: dict[str, int]):
        raw = [w.encode() for w in numbers]
        if any(len(w) > 16 for w in raw):
            raise ValueError("words of at most 16 bytes")
        low, high = (np.array([_cut(w, k) for w in raw], np.uint64) for k in (0, 8))
        order = np.lexsort((high, low))
        self.low, self.high = low[order], high[order]
        self.heads, self.first = np.unique(self.low, return_index=True)
        self.last = np.append(self.first[1:], len(self.low))
        self.numbers = np.array(list(numbers.values()))[order]

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        low = _view(data, "<u8")[starts] & _KEEP[np.minimum(lengths, 8)]
        out = np.zeros(len(starts), np.int64)
        slot = np.minimum(np.searchsorted(self.heads, low), len(self.heads) - 1)
        at = np.flatnonzero((self.heads[slot] == low) & (lengths <= 16))
        slot, high = slot[at], _view(data, "<u8", 8)[starts[at]] & _KEEP[np.clip(lengths[at] - 8, 0, 8)]
        for k in range(int((self.last - self.first).max())):  # words that share their first eight bytes
            j = np.minimum(self.first[slot] + k, self.last[slot] - 1)
            same = self.high[j] == high
            out[at[same]] = self.numbers[j[same]]
        return out


POSITIVE, NEGATIVE, NEGATION = 1, 2, 4


def _signed(data: np.ndarray, offsets: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative words of each row; a negation among the `window` words before turns one over.

    Words are runs of letters, with the contracted `n't` as a word of its own.
    """
    letter = _classes(data, "L", b"")
    at = np.flatnonzero((_view(data, "<u4") & np.uint32(0xFFFFFF)) == np.uint32(_cut(b"n't", 0)))
    row = np.searchsorted(offsets, at, "right") - 1
    before = data[at - 1]
    parted = (at == offsets[row]) | ((before >= 97) & (before <= 122)) | ~letter[at - 1]
    at = at[(at + 3 <= offsets[row + 1]) & parted]
    letter[at + 1] = True  # its apostrophe
    after = at + 3
    starts, lengths = _runs(letter, offsets, np.concatenate([at, after[after < len(letter)]]))
    of = _rows(starts, offsets)
    number = words.of(data, starts, lengths)
    negation = (number & NEGATION) > 0
    negated = np.zeros(len(starts), bool)
    for k in range(1, window + 1):
        negated[k:] |= negation[:-k] & (of[k:] == of[:-k])
    positive = np.where(negated, number & 3 == NEGATIVE, number & 3 == POSITIVE)
    negative = np.where(negated, number & 3 == POSITIVE, number & 3 == NEGATIVE)
    n = len(offsets) - 1
    return np.bincount(of[positive], minlength=n), np.bincount(of[negative], minlength=n)


def _numbers(positive: Sequence[str], negative: Sequence[str], negations: Sequence[str]) -> dict[str, int]:
    kinds = {w: NEGATIVE for w in negative} | {w: POSITIVE for w in positive}
    return {w: kinds.get(w, 0) | (NEGATION if w in negations else 0) for w in (*kinds, *negations)}


def _struct(columns: dict[str, np.ndarray], nulls: np.ndarray) -> pa.StructArray:
    """Null texts have null in every field."""
    return pa.StructArray.from_arrays([pa.array(v, mask=nulls) for v in columns.values()], list(columns))


def _type(names: Sequence[str], kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, kind) for k in names])


def _nulls(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)


def _joined(parts: list[dict[str, np.ndarray]], names: Sequence[str], kind) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.zeros(0, kind) for k in names}


class Found:
    """Which of the phrases occur in a text, as columns of bits; `column` is what `search` or `grading` gave."""

    def __init__(self, column: Column, phrases: Sequence[str]):
        self.column, self.at = column, {p: i for i, p in enumerate(phrases)}

    def _masked(self, phrases: Sequence[str]) -> list[Column]:
        masks: dict[int, int] = {}
        for p in phrases:
            i = self.at[p]
            masks[i // BITS] = masks.get(i // BITS, 0) | 1 << i % BITS
        return [self.column[f"b{k}"].bitwiseAND(F.lit(m).cast("long")) for k, m in sorted(masks.items())]

    def n_hits(self, phrases: Sequence[str]) -> Column:
        """How many of the phrases occur; each counts once."""
        return sum((F.bit_count(m) for m in self._masked(phrases)), F.lit(0))

    def any_hit(self, phrases: Sequence[str]) -> Column:
        out = F.lit(False)
        for m in self._masked(phrases):
            out = out | (m != 0)
        return out


def _bits(phrases: Sequence[str]) -> list[str]:
    return [f"b{k}" for k in range(-(-len(phrases) // BITS))]


def _bits_of(known: Phrases, names: Sequence[str], data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(offsets) - 1, np.int64) for k in names}
    for i, rows in known.find(data, offsets):
        out[names[i // BITS]][rows] |= 1 << i % BITS
    return out


def _unique(phrases: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(phrases))


def searcher(phrases: Sequence[str]) -> tuple[Callable[[Column], Column], Callable[[Column], Found]]:
    """A search of lower-case text for all phrases, and the reader of its result."""
    phrases = _unique(phrases)
    names = _bits(phrases)
    known = Phrases(phrases)

    def each(texts: pa.Array) -> pa.Array:
        parts = [_bits_of(known, names, *s) for s in _slices(texts)]
        return _struct(_joined(parts, names, np.int64), _nulls(texts))

    return F.arrow_udf(each, _type(names, T.LongType())), lambda column: Found(column, phrases)


def clause_facts(groups: Sequence[Sequence[str]], positive: Sequence[str], negative: Sequence[str], negations: Sequence[str], window: int) -> Callable[[Column], Column]:
    """For each text of an array: positive and negative words, and bit g of `about` where a phrase of group g occurs."""
    phrases = _unique([p for g in groups for p in g])
    groups_of = [sum(1 << g for g, group in enumerate(groups) if p in group) for p in phrases]
    known, words = Phrases(phrases), Words(_numbers(positive, negative, negations))
    names = ("positive_words", "negative_words", "about")

    def facts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        about = np.zeros(len(offsets) - 1, np.int64)
        for i, rows in known.find(data, offsets):
            about[rows] |= groups_of[i]
        return dict(zip(names, (*_signed(data, offsets, words, window), about), strict=True))

    def each(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.large_list(pa.large_string()))
        texts = lists.flatten()
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        inner = _struct(_joined([facts(*s) for s in _slices(texts)], names, np.int32), _nulls(texts))
        offsets = np.cumsum(np.append(0, sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=pa.array(_nulls(lists)))

    return F.arrow_udf(each, T.ArrayType(_type(names, T.IntegerType())))


def grading(phrases: Sequence[str], pronouns: Sequence[str], positive: Sequence[str], negative: Sequence[str], negations: Sequence[str], window: int) -> tuple[Callable[[Column], Column], Callable[[Column], Found]]:
    """A search for all phrases as `searcher`, with positive and negative words and the number of pronouns."""
    phrases = _unique(phrases)
    bits = _bits(phrases)
    names = (*bits, "positive_words", "negative_words", "pronouns")
    known, words, asked = Phrases(phrases), Words(_numbers(positive, negative, negations)), Words({p: 1 for p in pronouns})

    def facts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        starts, lengths = _runs(_classes(data, "LN", b"_"), offsets)
        hit = asked.of(data, starts, lengths) > 0
        count = np.bincount(_rows(starts, offsets)[hit], minlength=len(offsets) - 1)
        signs = _signed(data, offsets, words, window)
        return _bits_of(known, bits, data, offsets) | dict(zip(names[len(bits) :], (*signs, count), strict=True))

    def each(texts: pa.Array) -> pa.Array:
        return _struct(_joined([facts(*s) for s in _slices(texts)], names, np.int64), _nulls(texts))

    return F.arrow_udf(each, _type(names, T.LongType())), lambda column: Found(column, phrases)
