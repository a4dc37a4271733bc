"""Facts of clauses, found in batches, against plain Python."""

from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.operators import aspects
from test_search import rows, signs  # noqa: F401


def test_facts_of_clauses(rows):
    lists = rows.select(F.when(F.col("id") != 1, F.array("t", F.lit("fresh food"), F.lit(None), F.upper("t"))).alias("l"))
    for l, facts in lists.select("l", aspects._facts(F.col("l"))).collect():
        if l is None:
            assert facts is None
            continue
        for t, f in zip(l, facts, strict=True):
            about = None if t is None else sum(1 << i for i, a in enumerate(lx.ASPECTS) if any(k in t for k in lx.ASPECT_KEYWORDS[a]))
            assert tuple(f) == ((None, None, None) if t is None else (*signs(t), about)), t
