"""Near copies and benchmark leaks against brute force."""

from llm import brute
import numpy as np
import pytest

from reviewlake.llm import decontamination as D
from reviewlake.llm import jaccard_join as J


@pytest.mark.parametrize("chunk", [512, 5])
def test_jaccard_join_equals_brute_force(docs, corpus, chunk):
    rows = J.jaccard_join(docs(corpus, clash=True), chunk=chunk).collect()
    expected, _ = brute.near(corpus)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in rows) == sorted((str(i), str(c), n) for i, c, n in expected)


def test_keep_one(docs, corpus):
    kept = J.keep_one(docs(corpus, clash=True)).collect()
    _, groups = brute.near(corpus)
    assert len(kept) == len(set(groups)) and kept[0].slot == "x"
    of = {(i, t): g for (i, t), g in zip(corpus, groups, strict=True)}
    assert {of[r.doc_id, r.text] for r in kept} == set(groups)
    assert J.keep_one(docs([])).count() == 0 and J.jaccard_join(docs([])).count() == 0


def test_a_large_group_of_near_copies(docs, spark):
    """Several chunks, pairs on both sides of the threshold; no text is linked to more than brute force finds."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        body = list(base)
        for at in rng.choice(80, rng.integers(0, 3), replace=False):
            body[at] = f"x{i % 40}"
        rows.append((i, " ".join(body)))
    got = J.jaccard_join(docs(rows), chunk=16).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute.near(rows)[0])


def test_pruning_keeps_pairs_at_the_threshold():
    needed = J.needed_matches(0.8, J.TOLERANCE)
    rng = np.random.default_rng(5)
    for n, least in needed.items():
        assert (rng.binomial(n, 0.8, 200_000) >= least).mean() > 0.9999


@pytest.fixture
def items(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"q{rng.integers(0, 60)}" for _ in range(n)) for n in (14, 25, 40, 59, 3, 5)]
    return [(k, t) for k, t in enumerate(texts)] + [(10, None), (11, ""), (12, texts[1]), (13, texts[2] + " tail of words")]


def leaky(items, corpus):
    rng = np.random.default_rng(7)
    rows = list(corpus)
    for k, (_, text) in enumerate(items[:6] * 3):
        w = text.split()
        if k >= 6:
            w[rng.integers(len(w))] = "changed"
        if k >= 12:
            w = w[: max(1, len(w) - 2)]
        rows.append((1000 + k, f"{corpus[k][1]} {' '.join(w).upper()}\nrest of it"))
    rows += [(2000, items[0][1]), (2001, " ".join(items[3][1].split()[:-3])), (2002, items[4][1])]
    return rows


def test_decontamination_equals_brute_force(docs, spark, corpus, items, monkeypatch):
    rows, bench = leaky(items, corpus), spark.createDataFrame(items, "item_id long, text string")
    expected = [x for x in brute.leaks(rows, items)]
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in D.matches(docs(rows, clash=True), bench).collect())
    assert got == expected and len({i for i, _, _ in got}) >= 10
    kept = D.clean(docs(rows, clash=True), bench).collect()
    bad = {i for i, _, _ in expected}
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if i not in bad) and kept[0].slot == "x"
    chunks = D.item_chunks
    monkeypatch.setattr(D, "item_chunks", lambda b: chunks(b, 30))
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in D.matches(docs(rows), bench).collect()) == expected


def test_decontamination_of_empty_tables(docs, spark, items):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert D.matches(docs([(1, "a b c d e f")]), none).count() == 0 and D.clean(docs([(1, "a b c d e f")]), none).count() == 1
    assert D.matches(docs([]), some).count() == 0 and D.clean(docs([]), some).count() == 0


def test_copies_of_items_with_runs_of_equal_words_are_found(docs, spark):
    rng = np.random.default_rng(8)
    texts = []
    for n, times, run in ((12, 1, 10), (20, 1, 34), (6, 2, 14), (8, 1, 12), (30, 3, 9)):
        word = lambda: f"r{rng.integers(0, 10**6)}"
        texts.append(" ".join(" ".join([*[word() for _ in range(n)], *["_"] * run]) for _ in range(times)) + f" {word()} {word()}")
    items = list(enumerate(texts))
    rows = [(k, t) for k, t in items] + [(100 + k, f"some words _ _ before {t} _ _ _ and some after") for k, t in items]
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in D.matches(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute.leaks(rows, items) and {(i, j) for i, j, _ in got} >= {(k + d, k) for k, _ in items for d in (0, 100)}


def test_window_sums_count_each_name_once():
    rng = np.random.default_rng(9)
    names = rng.integers(0, 6, 60).astype(np.uint64)
    weights = (names + 1).astype(np.float32)
    for width in (1, 4, 17, 80):
        got = D._window_sums(names, weights, width)
        for at in range(60):
            x = np.unique(names[at : at + width])
            assert np.allclose(got[at], (D._bits(x) * (x + 1)[:, None].astype(np.float32)).sum(0), atol=1e-3)


def test_short_items_inside_longer_texts(spark, docs, tmp_path):
    rows = [(1, "to be OR not to be"), (2, "a be"), (3, "one"), (4, "x One\ny one z w v u"), (5, "be or not"), (6, None), (7, "to be or\tnot"), (8, "or not be to"), (9, "p q r s t u v")]
    items = [(1, "be or not"), (2, "one"), (3, "to be or not"), (4, "a be c d"), (5, "p q r s t u v"), (6, "ONE"), (7, "")]
    expected = [(1, 1, 1), (1, 3, 0), (3, 2, 0), (3, 6, 0), (4, 2, 1), (4, 6, 1), (5, 1, 0), (7, 1, 1), (7, 3, 0), (9, 5, 0)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op7_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == expected and {r.similarity for r in got} == {1.0}
    assert sorted(r.doc_id for r in D.clean(docs(rows), bench).collect()) == [2, 6, 8]


def _chunk(texts):
    """Items of a chunk, as the tasks get them, with equal weights."""
    rows = []
    for j, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        names, _, valid = D.shingle_rows(data, np.array([0, len(data)]))
        distinct = np.unique(names[valid]).astype(np.int64).tolist()
        rows.append({"item_id": j, "words": len(names), "names": distinct, "weights": [1.0] * len(distinct)})
    return D.Items(rows)


def test_memory_does_not_grow_with_the_distance_of_hits():
    import tracemalloc

    rng = np.random.default_rng(12)
    word = [f"w{j}" for j in rng.integers(0, 10**6, 60)]
    items = _chunk([" ".join(word)])
    filler = " ".join(f"t{j}" for j in rng.integers(0, 10**7, 1_250_000))
    half = len(filler) // 2
    text = f"{' '.join(word[:34])} {filler[:half]} {' '.join(word)} {filler[half:]} {' '.join(word[26:])}"
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(data) > 10_000_000
    tracemalloc.start()
    got = list(D.scan(data, np.array([0, len(data)]), items, 1.0, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and got[0][:2] == (0, 0) and got[0][3] == pytest.approx(1.0) and got[0][2] == len(text[: text.index(" ".join(word))].split())
    assert peak < 500 << 20


@pytest.mark.parametrize("step", [1, 7, 64, 4096])
def test_steps_of_windows_find_the_same(monkeypatch, step):
    rng = np.random.default_rng(13)
    word = [f"w{j}" for j in range(30)]
    items = _chunk([" ".join(word), " ".join(word[5:25])])
    parts = []
    for _ in range(40):
        own = list(word)
        for j in rng.integers(0, 30, rng.integers(0, 3)):
            own[j] = "other"
        parts += [*own, *(f"f{j}" for j in rng.integers(0, 1000, rng.integers(0, 90)))]
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    whole = list(D.scan(data, np.array([0, len(data)]), items, 1.0, 0.8))
    monkeypatch.setattr(D, "STEP", step)
    assert [x[:3] for x in D.scan(data, np.array([0, len(data)]), items, 1.0, 0.8)] == [x[:3] for x in whole] and len(whole) == 2


@pytest.mark.parametrize("light", [1.0, 0.2])
def test_fingerprints_keep_windows_that_count(light):
    """Recall of the radius at similarity 0.8 to 0.9, where a third of the item's shingles weigh less."""
    rng = np.random.default_rng(14)
    kept = seen = 0
    for trial in range(300):
        n = int(rng.integers(20, 200))
        names = rng.integers(1, 1 << 63, n).astype(np.uint64)
        weights = np.where(rng.random(n) < 0.33, light, 1.0)
        items = D.Items([{"item_id": 0, "words": n + 4, "names": names.astype(np.int64).tolist(), "weights": weights.tolist()}])
        window, order, lost, new = names.copy(), rng.permutation(n), 0.0, 0.0
        for j in order.tolist():  # replaced shingles cost their weight and bring another one's
            if (weights.sum() - lost - weights[j]) / (weights.sum() + new + 1.0) < 0.8:
                break
            lost, new = lost + weights[j], new + 1.0
            window[j] = rng.integers(1, 1 << 63)
        text = np.append(window, np.zeros(4, np.uint64))
        near, _, _ = D.near_windows(text, np.arange(n + 4) < n, np.array([0]), 0, items, 1.0)
        seen, kept = seen + 1, kept + int(near[0])
    assert kept / seen >= 0.99
