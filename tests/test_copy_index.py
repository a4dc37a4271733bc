"""Duplicate counts over loads against one read of everything; old data stays unread."""

import random

import pytest

from reviewlake.operators import copy_index as X
from reviewlake.operators import validation
from reviewlake.session import scratch_dir
from reviewlake.sources import readers

COLUMNS = readers.string_schema().names


def rows(seed, n):
    rng = random.Random(seed)
    return [tuple(rng.choice([f"{c}{rng.randrange(3)}", None]) if c != "reviewText" else rng.choice([None, "", f"text {rng.randrange(60)}"]) for c in COLUMNS) for _ in range(n)]


@pytest.fixture
def frame(spark):
    return lambda data: spark.createDataFrame(data, readers.string_schema())


def counted(df):
    return {r.kind: r.rows for r in df.collect()}


def test_sums_of_loads_are_the_counts_of_one_read(spark, frame):
    first, second, third = rows(1, 80), rows(2, 70), rows(3, 5)
    second += first[:6] + [second[0]] * 5 + [first[7]] * 3
    third += second[-2:] + [tuple("unseen" for _ in COLUMNS)]
    index, total = scratch_dir(spark, "index"), {"exact_duplicates": 0, "duplicate_texts": 0}
    seen = []
    for name, load in (("d1", first), ("d2", second), ("d3", third)):
        X.add_load(spark, index, name, frame(load), buckets=4)
        for kind, n in counted(X.load_report(spark, index, name)).items():
            total[kind] += n
        fresh = X.new_rows(spark, index, name, frame(load)).collect()
        assert sorted(map(tuple, fresh), key=str) == sorted(set(load) - set(seen), key=str)
        seen += load
        assert total == counted(validation.duplicate_report(frame(seen)))
    X.add_load(spark, index, "d2", frame(second), buckets=4)  # a repeated run replaces itself
    again = X.seen_before(spark, index, "d2")
    assert {r.earlier for r in again.collect()} and again.select("kind", "digest").distinct().count() == again.count()


def test_buckets_without_a_hit_are_not_read(spark, frame):
    index = scratch_dir(spark, "index")
    old = [tuple(f"{c}-{i}" for c in COLUMNS) for i in range(300)]
    X.add_load(spark, index, "old", frame(old), buckets=16)
    X.add_load(spark, index, "new", frame([tuple(f"other-{c}" for c in COLUMNS), old[5]]), buckets=16)
    got = X.seen_before(spark, index, "new")
    assert sorted((r.kind, r.n, r.earlier) for r in got.collect()) == [("exact", 1, 1), ("text", 1, 1)]
    read = [f for f in got.inputFiles() if "load=old" in f]
    assert 1 <= len(read) <= 4
    X.add_load(spark, index, "none", frame([tuple("n/a" for _ in COLUMNS)]), buckets=16)
    assert X.seen_before(spark, index, "none").count() == 0


def test_filters_never_miss():
    rng = random.Random(5)
    inside = [rng.randbytes(32) for _ in range(2000)]
    outside = [rng.randbytes(32) for _ in range(5000)]
    made = X.bloom(inside)
    assert X.passes(made, inside).all() and X.passes(made, outside).mean() < 0.03
    assert X.passes(X.bloom(inside[:1]), inside[:1]).all()


def test_empty_load(spark, frame):
    index = scratch_dir(spark, "index")
    X.add_load(spark, index, "a", frame(rows(4, 20)), buckets=2)
    X.add_load(spark, index, "b", frame([]), buckets=2)
    assert counted(X.load_report(spark, index, "b")) == {"exact_duplicates": 0, "duplicate_texts": 0}
