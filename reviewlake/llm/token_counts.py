"""Token counts of the sections of documents by offset-mapped attribution.

A whole document is encoded once, so counts add up to what a model sees. The ids' byte lengths give each token's span, and
spans are joined to sections by bisection of the section borders. A token that crosses a border belongs, by `rule`, to the
section with most of its bytes, ties to the earlier one ("most"), or to the section where it begins ("start").

Sections are the intervals between the character positions of a `borders` column, or the lines of the text (each with its
line break). Positions are characters. Positions outside the text, repeated or unsorted ones change nothing but the cuts
they name. There is no shuffle: a document's spans and sections meet in its own row.

Null text is empty; a document without text has one empty section 0 with no tokens, so every row of the input is seen.
Repeated rows give repeated results. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C
from reviewlake.llm import token_ids

RULES = ("most", "start")


def attribute(sizes: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a border; `cuts` are the sections' borders in bytes, ends included."""
    n = len(cuts) - 1
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, stop, "left") - 1
    owner = first.copy()
    cross = np.flatnonzero(last > first)
    if rule == "most":
        for j in cross:
            inside = np.arange(first[j], last[j] + 1)
            share = np.minimum(cuts[inside + 1], stop[j]) - np.maximum(cuts[inside], start[j])
            owner[j] = inside[np.argmax(share)]
    return np.bincount(owner, minlength=n), np.bincount(owner[cross], minlength=n)


def token_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", borders: Column | None = None, rule: str = "most", path: str | None = None) -> DataFrame:
    """doc_id, section (from 0), start, stop (characters), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or token_ids.default_path()

    def each(batches):
        for batch in C.slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = []
            given = batch.column(2).to_pylist()
            for j, body in enumerate(batch.column(1).to_pylist()):
                raw = np.frombuffer(body.encode(), np.uint8)
                at_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each character
                if given[j] is None:
                    cuts = np.flatnonzero(raw == 10) + 1
                else:
                    marks = np.array([p for p in given[j] if p is not None and 0 < p < len(at_char)], np.int64)
                    cuts = at_char[np.unique(marks)]
                cuts = np.unique(np.concatenate([[0], cuts, [len(raw)]]))
                if len(cuts) == 1:
                    cuts = np.zeros(2, np.int64)
                    tokens = crossing = np.zeros(1, np.int64)
                else:
                    ids, lengths = token_ids.encode(path, body)
                    sizes = lengths[np.array(ids, np.int64)]
                    tokens, crossing = attribute(sizes, cuts, rule)
                chars = np.searchsorted(at_char, cuts)
                n = len(cuts) - 1
                rows.append(np.full(n, j))
                for got, x in zip(out, (np.arange(n), chars[:-1], chars[1:], tokens, crossing), strict=True):
                    got.append(x)
            joined = [np.concatenate(x) for x in out]
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(joined[0].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in joined[1:]]
            ], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    cut = F.lit(None).cast("array<long>") if borders is None else borders.cast("array<long>")
    slim = docs.select(F.col(id_column).alias("doc_id"), C.text_or_empty(text).alias("text"), cut.alias("borders"))
    return slim.mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_column]}, section int, start long, stop long, n_tokens long, n_crossing long")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all `documents`."""
    return token_counts(C.table(spark, folder, "documents"))
