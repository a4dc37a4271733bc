"""The pipeline against brute force, stage by stage, and the registration of the queries."""

import zlib

from llm import brute
import numpy as np
import __spark_entry__ as entry
import corpus_pipeline as P
from conftest import DATA

from reviewlake.llm import token_ids, toxicity
from reviewlake.llm.common import table


def test_run_equals_brute_force(spark, docs):
    docs([])
    source = table(spark, DATA, "documents").select("doc_id", "text")
    scorer = toxicity.fit(source, toxicity.labelled(spark, DATA, "toxic"), ~toxicity.held_out())
    rows = [(r.doc_id, r.text) for r in toxicity.score(source, scorer).filter("toxic_score < 0.7").collect()]
    _, groups = brute.near(rows)
    first = {}
    for (i, _), g in zip(rows, groups, strict=True):
        first[g] = min(i, first.get(g, i))
    rows = [(i, t) for (i, t), g in zip(rows, groups, strict=True) if first[g] == i]
    rows = [(r[0], r[5].decode("utf-8", "ignore")) for r in brute.repeats(rows, P.PASSAGE)]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    bad = {i for i, _, _ in brute.leaks(rows, items)}
    encode, _ = token_ids.encoder(token_ids.default_path())
    expected = []
    for i, text in rows:
        if i not in bad:
            ids = np.array([*encode.encode_ordinary(text), 0], "<u4")
            cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
            expected += [(i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = P.run(spark, DATA).collect()
    assert sorted(r[:5] for r in map(tuple, got)) == sorted(expected) and bad and len(rows) < source.count()
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


def test_stages_take_effect_and_keep_columns(spark, docs):
    rows = docs([(1, "x"), (2, None), (2, None), (3, "")]).selectExpr("*", "'en' lang", "'s' source", "1L n_chars", "'clash' slot", "1 key")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert tuple(out.columns) == P.COLUMNS, name
        assert stage(spark, rows.limit(0), DATA).count() == 0
        assert out.count() == (3 if name == "jaccard_join" else 4), name
    assert P.STAGES[-1][1](spark, rows, DATA).count() == 4


def test_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_passages_of_over_fifty_words_go(spark, docs):
    """Fifty-one words that two otherwise different documents share, of the length of this language's words and shorter."""
    import random

    rng = random.Random(6)
    source = [r.text.split() for r in table(spark, DATA, "documents").filter("lang = 'en' AND n_chars > 900").limit(40).collect()]
    short = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    plain = lambda n: [rng.choice(short) + rng.choice(short) for _ in range(n)]
    rows, passages = [], {}
    for n, words in enumerate([*source[:20], *([rng.choice(short) for _ in range(51)] for _ in range(20))]):
        passages[n] = " ".join(words[:51])
        for k in (0, 1):
            rows.append((2 * n + k, " ".join([*plain(30), passages[n], *plain(30)])))
    frame = docs(rows).selectExpr("*", "'en' lang", "'s' source", "1L n_chars")
    kept = {r.doc_id: r.text for r in P.without_repeats(spark, frame, DATA).collect()}
    assert len(kept) == 80 and all(passages[i // 2] not in t for i, t in kept.items())
    assert all(len(t) > 250 for t in kept.values())
