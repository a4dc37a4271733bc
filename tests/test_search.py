"""The searches in batches against plain Python, on texts made to meet their borders."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions import search
from reviewlake.operators import aspects, reply_quality, triage

PIECES = (
    "food", " good", "not ", "wasn't ", "n't", "bad", ", ", " never ", "é", "great", "ñn't", " fine", "—", "中文", "we", "our_", " us ", "us9", "²", "", "disappointing",
    "uncomfortable ", "uncomfortably ", "we sincerely", "thank you for bringing this to our attention", "thank you for bringing this to our", "hair", "ha", "ir", "'", "t", "𝒳", "\n",
)


def made(n: int = 400) -> list:
    rng = random.Random(7)
    return [None, "", "n't", "hair", *["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]]


def signs(text: str) -> tuple[int, int]:
    letters = "".join(c if c.isalpha() or c == "'" else " " for c in re.sub("([a-z])n't", r"\1 n't", text))
    words = re.findall(r"n't|[^\W\d_]+", letters)
    found = [0, 0]
    for i, w in enumerate(words):
        kind = 0 if w in lx.POSITIVE_WORDS else 1 if w in lx.NEGATIVE_WORDS else None
        if kind is not None:
            found[kind ^ any(b in lx.NEGATIONS for b in words[max(0, i - aspects.NEGATION_WINDOW) : i])] += 1
    return tuple(found)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(made())), "id int, t string").repartition(3)


def test_phrases_words_and_pronouns(rows, monkeypatch):
    monkeypatch.setattr(search, "STEP", 300)  # many slices
    facts = reply_quality._search(F.col("t"))
    found = reply_quality._found(facts)
    asked = [lx.EMPATHY_HIGH, lx.GENERIC_PHRASES, lx.SPECIFIC_TERMS, lx.CASUAL_TERMS]
    got = rows.select("t", *[found.n_hits(p).alias(f"n{i}") for i, p in enumerate(asked)], found.any_hit(lx.GENERIC_PHRASES).alias("any"), facts["positive_words"].alias("p"),
                      facts["negative_words"].alias("n"), facts["pronouns"].alias("us")).collect()
    for r in got:
        if r.t is None:
            assert all(v is None for v in r[1:])
            continue
        assert [r[f"n{i}"] for i in range(4)] == [sum(x in r.t for x in p) for p in asked], r.t
        assert r.any == any(x in r.t for x in lx.GENERIC_PHRASES)
        assert (r.p, r.n) == signs(r.t), r.t
        assert r.us == sum(w in lx.PRONOUNS for w in re.findall(r"\w+", r.t)), r.t
    assert max(r.p for r in got if r.t) > 2 and max(r.us for r in got if r.t) > 1


def test_a_text_is_searched_once_per_operator(spark):
    """Grading plans one search each for issues, sarcasm, clauses and reply, and does not copy the analysis into another expression."""
    df = spark.createDataFrame([(1, "fine food", 5, 0.9)], "review_id long, reviewText string, p int, confidence double")
    plan = reply_quality.score_replies(triage.triage(df))._jdf.queryExecution().optimizedPlan().toString()
    calls = len(re.findall(r"each\(", plan))
    assert calls <= 5 and "Contains(text_lc" not in plan and len(plan) < 100_000
