import random

import pytest

from reviewlake.llm.common import shipped

SCHEMA = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) rows, with columns whose names clash with results and helpers on request."""
    shipped(spark)

    def make(rows, clash=False):
        df = spark.createDataFrame(list(rows), SCHEMA)
        if clash:
            names = "slot key label score n_bytes spans __bucket least name row toxic_score length section".split()
            df = df.selectExpr("*", *[f"'x' AS {n}" for n in names])
        return df

    return make


@pytest.fixture
def corpus():
    """Random texts with shared passages, near copies, copies, repeated rows, nulls, empty, blank, long and non-ASCII texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 30, 150]))]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body)), rng.choice(passages))
        rows.append((i, " ".join(body) + rng.choice(["", "\n", ".\nLast line"])))
    for i in range(60, 90):
        body = rows[i % 7 + 20][1].split(" ")
        body[rng.randrange(len(body))] = rng.choice(words)
        rows.append((i, " ".join(body)))
    rows += [(90 + k, rows[k][1]) for k in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a" * 3000), (204, "ab " * 900), (205, "ÄÖ " + rows[3][1].upper()), (206, " ".join(rng.choice(words) for _ in range(9000)))]
    rows += [rows[5], rows[5], (None, rows[9][1]), (None, "alone without an id"), (rows[12][0], "another text of a known id")]
    return rows
