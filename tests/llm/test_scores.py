"""Toxicity, quality, fingerprints and shards."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import common as C
from reviewlake.llm import fingerprints as FP
from reviewlake.llm import quality as Q
from reviewlake.llm import sharding as S
from reviewlake.llm import toxicity as X

SMALL = "/root/testdata/sf0.01"


def best_first(v):
    """Maximal scoring segments by definition: the best one, then those left and right of it."""
    found = [(sum(v[i : j + 1]), i - j, i, j) for i in range(len(v)) for j in range(i, len(v)) if sum(v[i : j + 1]) > 1e-9]
    if not found:
        return []
    top = max(round(x[0], 9) for x in found)
    s, _, i, j = max((x for x in found if round(x[0], 9) == top), key=lambda x: x[1])
    return [*best_first(v[:i]), (i, j, round(s, 6)), *[(a + j + 1, b + j + 1, c) for a, b, c in best_first(v[j + 1 :])]]


def test_segments_equal_their_definition():
    rng = random.Random(8)
    for _ in range(200):
        v = [rng.choice([-0.5, -0.5, 1.13, 2.31, 0.77]) for _ in range(rng.randint(0, 16))]
        at = np.array([i for i, x in enumerate(v) if x > 0], int)
        assert [(a, b, round(s, 6)) for a, b, s in X.segments(at, np.array([v[i] for i in at]))] == best_first(v)


@pytest.mark.parametrize(("query", "label", "least"), [(X.op4_toxicity, "toxic", 0.97), (Q.op9_quality, "quality", 0.98)])
def test_held_out_accuracy(spark, docs, query, label, least):
    docs([])
    rows = query(spark, SMALL).join(X.labelled(spark, SMALL, label), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.predicted == r.label for r in held) / len(held) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if label == "toxic" else 0.5)) for r in rows)


def labelled_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        body, bad = [word() for _ in range(rng.randint(5, 60))], i % 5 == 0
        if bad:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), "vile" + rng.choice(["st", "ness", "ly", ""]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_passages_and_edge_rows(docs, spark):
    rows, labels = labelled_corpus()
    table = spark.createDataFrame([*labels, (3, 1), (None, 1), (4, None)], "doc_id long, label int")
    extra = [(500, None), (501, ""), (502, "some vileful thing"), (503, "Größe: vile, VILE vilest " + "calm " * 30_000), rows[0], rows[0], (None, "no id")]
    scorer = X.fit(docs(rows).select("doc_id", "text"), table, F.col("doc_id") % 3 != 1)
    got = X.score(docs(rows + extra, clash=True), scorer).collect()
    assert len(got) == len(rows) + len(extra) and got[0].slot == "x"
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if i % 3 == 1]
    assert all((by[i].toxic_score >= X.CUT) == (i % 5 == 0) for i in held)
    assert by[500].toxic_score == by[501].toxic_score < 0.5 < by[502].toxic_score
    text = extra[3][1]
    assert [text[p.start : p.stop] for p in by[503].toxic_passages] == ["vile, VILE vilest"]
    assert len({r.toxic_score for r in got if r.doc_id == 0}) == 1
    assert X.score(docs([]), scorer).count() == 0


def test_labels_of_one_class_or_none(docs, spark):
    body = docs([(1, "a b c"), (2, None)])
    for labels, expected in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        table = spark.createDataFrame(labels, "doc_id long, label int")
        scorer = X.fit(body.select("doc_id", C.text_or_empty().alias("text")), table, F.lit(True))
        assert all(abs(r.toxic_score - expected) < 1e-6 for r in X.score(body, scorer).collect())
        got = Q.classify(Q.with_statistics(body), table, F.lit(True)).collect()
        assert all(r.score == (expected if labels else 0.5) for r in got)


def test_statistics_do_not_depend_on_neighbours(docs, corpus):
    texts = [(t or "").encode() for _, t in corpus]
    batch = Q.statistics(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    assert batch.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(batch).all()
    for j, t in enumerate(texts):
        assert np.allclose(batch[j], Q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
    assert Q.with_statistics(docs(corpus, clash=True)).count() == len(corpus) and Q.with_statistics(docs([])).count() == 0


def test_discriminant_is_a_difference_of_gaussian_log_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(500, 3)) @ a + m for a, m in ((np.diag([1, 2, 3.0]), 0), (np.eye(3) + 0.3, 2))]
    model = Q.Discriminant([(len(z), z.sum(0), z.T @ z) for z in x], shrink=0.0, ridge=0.0)
    for z in x:
        logs = []
        for y in x:
            c, d = np.cov(y.T, bias=True), z - y.mean(0)
            logs.append(-0.5 * (d @ np.linalg.inv(c) * d).sum(1) - 0.5 * np.log(np.linalg.det(c)))
        assert np.allclose(model.difference(z), np.clip(logs[1] - logs[0], -200, 200), rtol=0.02, atol=0.1)


def successors(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("size", [300, 1 << 24])
def test_fingerprints_of_documents_and_edits(docs, spark, corpus, tmp_path, size, monkeypatch):
    monkeypatch.setattr(FP, "RANGE_BYTES", size)
    monkeypatch.setattr(FP.with_next, "__defaults__", (size,))
    docs(corpus, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, FP.op10_fingerprints(spark, str(tmp_path)).collect()), key=str)
    expected = []
    for i, own, after in successors(corpus):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = FP.sketches([own.encode(), edited.encode(), after.encode()])
        expected.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), FP.to_hex(a), FP.to_hex(b), FP.likeness(a, b), FP.likeness(a, c)))
    assert got == sorted(expected, key=str)


def test_parsing_is_locally_consistent():
    rng = random.Random(2)
    common = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) + common for n in (0, 1, 17, 400)]
    sets = []
    for t in texts:
        names, _ = FP.phrases(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        sets.append(set(names.tolist()))
    inside = len(set.intersection(*sets))
    assert inside > 0.9 * len(sets[0])
    together, of = FP.phrases(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    assert [set(together[of == j].tolist()) for j in range(4)] == sets


def test_fingerprint_edge_texts(docs):
    got = {r.doc_id: r.fingerprint for r in FP.fingerprint(docs([(1, None), (2, ""), (3, "a"), (4, "a"), (5, "aaaaaaaa" * 500), (6, "b")], clash=True)).collect()}
    assert got[1] == got[2] == "" and got[3] == got[4] != got[6] and got[5]
    empty, full = np.zeros(0, np.uint32), np.array([1, 2], np.uint32)
    assert FP.likeness(empty, empty) == 1.0 and FP.likeness(empty, full) == 0.0 and FP.likeness(full, full) == 1.0


def test_shards(docs, corpus):
    rows = [*corpus, *[(k, f"text {k}") for k in range(3000, 5000)]]
    got = S.shard_documents(docs(rows, clash=True)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 400
    moved = [r for r in got if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 8 for r in moved) and len(moved) / len(got) == pytest.approx(1 / 9, abs=0.03)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    sizes = sorted(((t or "").encode().__len__() + 1) for _, t in rows)
    assert sorted(r.size for r in got) == sizes
    assert S.shard_documents(docs([])).count() == 0


def test_weights_move_rows_inside_changed_subtrees_only(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    place = lambda weights: [r[0] for r in keys.select(S.shard_of(F.col("k"), S.tree(8, weights))).collect()]
    before, after = place({}), place({3: 3.0})
    share = sum(a == 3 for a in after) / 4000
    assert share == pytest.approx(0.3, abs=0.03)
    for a, b in zip(before, after, strict=True):
        if a != b:  # towards the heavier region, or the heavier rack of it, or the heavier shard of that
            assert b == 3 or (b // 4 == 0 and a // 4 != 0) or (b // 2 == 1 and a // 2 != 1)
    assert 5 not in place({5: 0.0})
    with pytest.raises(ValueError, match="negative"):
        S.tree(2, {1: -1.0})
