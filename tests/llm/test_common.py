"""Byte views, spans and fingerprints."""

import numpy as np
import pyarrow as pa

from reviewlake.llm import common as C


def test_byte_view_of_slices_chunks_and_nulls():
    values = ["ab", None, "", "üx", "long " * 50]
    whole = pa.array(values)
    for column, expected in (
        (whole, values), (whole.slice(1, 3), values[1:4]), (pa.chunked_array([whole.slice(3), whole.slice(0, 2)]), values[3:] + values[:2]),
        (pa.array([], pa.string()), []), (pa.chunked_array([], pa.string()), []),
    ):
        data, offsets = C.byte_view(column)
        assert [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:], strict=False)] == [v or "" for v in expected]


def test_slices_keep_rows_and_bound_bytes():
    values = ["x" * n for n in (5, 0, 700, 3, 3, 3, 900)] + [None]
    batch = pa.record_batch([pa.array(range(8)), pa.array(values)], names=["doc_id", "text"])
    parts = list(C.slices([batch, batch.slice(0, 0)], most=10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 or max(len(t or "") for t in p.column(1).to_pylist()) > 10 for p in parts)


def test_word_spans_equal_split():
    texts = ["", " a  bc\t", "\n", "x", "", "ü y z"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    starts, ends, doc = C.word_spans(data, offsets)
    assert [(int(d), bytes(data[a:b])) for a, b, d in zip(starts, ends, doc, strict=True)] == [(d, w) for d, r in enumerate(raw) for w in r.split()]


def test_names_depend_on_content_and_length_only():
    data = np.frombuffer(b"abcabcab" * 40, np.uint8)
    marks = C.Rolling(data)
    starts = np.arange(0, 300, 7)
    names = marks.names(starts, starts + 9)
    for a, name in zip(starts, names, strict=True):
        same = [bytes(data[b : b + 9]) == bytes(data[a : a + 9]) for b in starts]
        assert same == (names == name).tolist()
    assert (C.span_names(data, starts, starts + 5, step=16) == marks.names(starts, starts + 5)).all()
    zero = np.zeros(50, np.uint8)
    assert len(set(C.Rolling(zero).names(np.zeros(50, int), np.arange(1, 51)).tolist())) == 50


def test_shard_runs_cover_sorted_names():
    names = np.sort(C.splitmix(np.arange(1000, dtype=C.U64)))
    for shards in (1, 8, 1024):
        runs = C.shard_runs(names, shards)
        assert [x for _, a, b in runs for x in range(a, b)] == list(range(1000))
        assert all((names[a:b] // C.U64((1 << 64) // shards if shards > 1 else (1 << 64) - 1) == s).all() for s, a, b in runs)
    assert C.shard_runs(names[:0], 8) == []
