"""Token ids, section counts and packing."""

import random
import zlib

import numpy as np
import pytest

from reviewlake.llm import packing as P
from reviewlake.llm import token_counts as TC
from reviewlake.llm import token_ids


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False)


def test_ids_equal_the_json_vocabulary(tokenizer, corpus, spark):
    encode, lengths = token_ids.encoder(token_ids.default_path())
    texts = [t or "" for _, t in corpus] + ["<|endoftext|> x", "a\n\n\n b  \t c", "日本語 text 🙂🙂", "'s 'LL 12 345", "\u0000   x"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        ids = encode.encode_ordinary(text)
        assert ids == tokenizer(text).ids and lengths[np.array(ids, int)].sum() == len(text.encode())


@pytest.mark.parametrize("rule", TC.RULES)
def test_sections_by_brute_force(docs, corpus, tokenizer, rule):
    from pyspark.sql import functions as F

    borders = F.array(*[F.lit(p) for p in (7, 3, 3, 11, 40, -2, 999_999)], F.lit(None).cast("int"))
    got = {}
    for r in TC.token_counts(docs([(k, t) for k, (_, t) in enumerate(corpus)], clash=True), borders=borders, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.stop, r.n_tokens, r.n_crossing))
    for k, (_, text) in enumerate(corpus):
        text = text or ""
        cuts = sorted({0, len(text), *[p for p in (3, 7, 11, 40) if p < len(text)]})
        if len(cuts) == 1:
            cuts = [0, 0]
        at = [len(text[:c].encode()) for c in cuts]
        tokens, crossing, begin = [0] * (len(cuts) - 1), [0] * (len(cuts) - 1), 0
        encode, lengths = token_ids.encoder(token_ids.default_path())
        for size in lengths[np.array(encode.encode_ordinary(text), int)].tolist():
            share = [max(0, min(b, begin + size) - max(a, begin)) for a, b in zip(at, at[1:], strict=False)]
            touched = [j for j, s in enumerate(share) if s]
            owner = max(touched, key=lambda j: (share[j], -j)) if rule == "most" else touched[0]
            tokens[owner] += 1
            crossing[owner] += len(touched) > 1
            begin += size
        assert sorted(got[k]) == [(j, cuts[j], cuts[j + 1], tokens[j], crossing[j]) for j in range(len(cuts) - 1)]


def test_lines_add_up_to_whole_documents(docs, corpus, tokenizer):
    rows = TC.token_counts(docs([(k, t) for k, (_, t) in enumerate(corpus)])).collect()
    for k, (_, text) in enumerate(corpus):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(tokenizer(text).ids)
        assert [r.section for r in own] == list(range(len(own))) and own[-1].stop == len(text or "")
        assert len(own) == max(1, len((text or "").split("\n")) - (text or "").endswith("\n"))
    assert TC.token_counts(docs([])).count() == 0
    with pytest.raises(ValueError, match="rule"):
        TC.token_counts(docs([]), rule="least")


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_packing_round_trip(docs, corpus, tokenizer, capacity):
    from reviewlake.llm.common import settled

    rows = P.pack(settled(P.pieces(docs(corpus, clash=True), capacity=capacity), "p"), capacity).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    expected = {}
    for i, text in corpus:
        ids = np.array([*tokenizer(text).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        expected.setdefault(i, []).extend((j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in expected.items()}
    assert P.pack(settled(P.pieces(docs([])), "p")).count() == 0


def test_plan_uses_every_length_and_few_sequences():
    rng = random.Random(3)
    for scale in (1, 7, 1000):
        have = np.zeros(2049, np.int64)
        for _ in range(3000):
            have[min(2048, 1 + int(rng.lognormvariate(6, 1)))] += scale
        used = P.plan(have)
        left = have.copy()
        for pattern, times in used:
            assert sum(pattern) <= 2048
            for length in pattern:
                left[length] -= times
        least = -(-int((have * np.arange(2049)).sum()) // 2048)
        assert not left.any() and sum(n for _, n in used) <= least * 1.01 + 1


def test_fit_is_non_negative_and_close():
    have = np.zeros(11, np.int64)
    have[[3, 7, 5, 10]] = 4, 4, 6, 2
    patterns = P.enumerate_patterns(have, 10)
    counts = P.fit_counts(patterns, have)
    assert (counts >= 0).all()
    used = sum(np.bincount(p, minlength=11) * c for p, c in zip(patterns, counts, strict=True))
    assert np.abs(used - have).max() < 0.01


def test_operators_use_the_ids_of_the_unmodified_tokenizer(docs, corpus):
    """Special strings and very long runs of white space included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    n = token_ids.LONG_RUN
    texts = ["<|endoftext|>", "é one<|endoftext|>two\n <|endoftext|>", "<|endoftext|", "x" + " " * 1_000_000 + "y", "\n" * n + "z", "a" + " \t" * (n // 2) + "b", "c" + "　" * (n - 1) + "d"]
    texts += [t for _, t in corpus]
    rows = list(enumerate(texts))
    pieces = P.pieces(docs(rows), capacity=1 << 22).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in pieces} == {k: (len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 0], "<u4").tobytes())) for k, t in rows}
    got = {}
    for r in TC.token_counts(docs(rows), rule="start").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {k: len(ids(t)) for k, t in rows}
