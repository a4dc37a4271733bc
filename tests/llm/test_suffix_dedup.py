from llm import brute
import pytest

from reviewlake.llm import suffix_dedup as S

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@pytest.mark.parametrize(("length", "block"), [(400, 1 << 22), (120, 700), (30, 5000), (7, 900), (1, 3000)])
def test_equals_brute_force(docs, corpus, length, block):
    rows = corpus if length > 30 else corpus[:40] + corpus[98:103]
    got = S.suffix_dedup(docs(rows), length=length, block_bytes=block).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted((r[:5] for r in brute.repeats(rows, length)), key=key)


def test_slices_inside_a_long_text(docs, corpus, monkeypatch):
    import numpy as np

    data = np.frombuffer(corpus[-6][1].encode() * 2, np.uint8)
    offsets = np.array([0, len(data)])
    whole = [x for part in S.sampled(data, offsets, 50) for x in part[2].tolist()]
    monkeypatch.setattr(S, "STEP", 1000)
    found = [(at, first, last) for at, _, f, la, _, _ in S.sampled(data, offsets, 50) for first, last in zip(f + at, la + at, strict=True)]
    starts = sorted(s for _, first, last in found for s in range(first, last + 1))
    assert starts == list(range(len(data) - 49)) and len(found) >= len(whole)


def test_kept_text_columns_and_empty(docs, corpus):
    got = S.suffix_dedup(docs(corpus, clash=True), length=60)
    rows = got.collect()
    expected = {(r[0], r[4]): r[5] for r in brute.repeats(corpus, 60)}
    for row in rows:
        assert row.kept_text == expected[row.doc_id, row.kept_sha256].decode("utf-8", "ignore")
        assert row.slot == "x" and isinstance(row.n_bytes, int) and sum(s.stop - s.start for s in row.spans) == row.n_removed
    assert len(rows) == len(corpus)
    assert S.suffix_dedup(docs([])).count() == 0


def test_query_marks_passages(spark, corpus, docs):
    """The query's rows are those of 400 bytes, with what 250 bytes would remove beside them, ids null or repeated."""
    from reviewlake.session import scratch_dir

    folder = scratch_dir(spark, "op1")
    docs(corpus).write.parquet(f"{folder}/documents.parquet")
    got = S.op1_suffix_dedup(spark, folder).collect()
    shorter = {(i, t or ""): r[2] for (i, t), r in zip(corpus, brute.repeats(corpus, S.PASSAGE), strict=True)}
    expected = [(*r[:5], shorter[i, t or ""]) for (i, t), r in zip(corpus, brute.repeats(corpus, 400), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert any(r.n_passage_bytes > r.n_removed for r in got)
