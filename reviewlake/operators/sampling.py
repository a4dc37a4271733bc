"""Class balancing, stratified splits and data-set statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.distributed import KEY_SPACE, ranked, spread_key
from reviewlake.session import settled

SEED = 42
TARGET = 900
TEST_TENTHS = 2      # test share 0.2
VALIDATION_PART = 8  # validation share 0.1 of all = one eighth of the rest


def balance(df: DataFrame, target: int = TARGET, label: str = "reviewRating", row_id: str = "review_id", seed: int = SEED) -> DataFrame:
    """Exactly `target` rows per class that occurs, with `draw` (1..target) and a shuffle key.

    Classes with enough rows give their first `target` rows by a pseudo-random
    key, without replacement; smaller ones are drawn from with replacement.
    Ranks come from bucketed totals, and only buckets that reach into the first
    `target` rows are moved, so a class with most of the data stays spread out.
    """
    classes = df.filter(F.col(label).isNotNull())
    picked = settled(ranked(classes, label, row_id, seed, at_most=target), "picked")  # at most `target` rows per class
    return _draws(picked, df.columns, target, label, row_id, seed)


def _draws(picked: DataFrame, names: list[str], target: int, label: str, row_id: str, seed: int) -> DataFrame:
    """Exactly `target` rows of each class from its first ones with `rank` and `group_rows`."""
    under = picked.filter(F.col("group_rows") >= target).withColumn("draw", F.col("rank"))
    small = picked.filter(F.col("group_rows") < target)
    draws = (
        small.select(F.col(label).alias("__label"), F.col("group_rows").alias("__n")).distinct()
        .select("__label", "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(target).cast("long"))).alias("draw"))
        .withColumn("__rank", F.pmod(F.col("draw") * 7919 + seed, F.col("__n")) + 1)
    )
    over = small.join(draws, (F.col(label) == F.col("__label")) & (F.col("rank") == F.col("__rank")))
    columns = [*names, "draw"]
    both = under.select(*columns).unionByName(over.select(*columns))
    return both.withColumn(
        "shuffle_key", F.pmod(spread_key(F.col(row_id), seed + 1) + F.col("draw") * 104729, F.lit(KEY_SPACE))
    )


def stratified_split(df: DataFrame, label: str = "reviewRating", row_id: str = "review_id", seed: int = SEED) -> DataFrame:
    """Add `split`: 20% test, 10% val, 70% train within every class (halves round up)."""
    r = ranked(df.filter(F.col(label).isNotNull()), label, row_id, seed)
    test, val = _held_out(F.col("group_rows"))
    split = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= test + val, "val").otherwise("train")
    return r.select(*df.columns, split.alias("split"))


def _held_out(n: Column) -> tuple[Column, Column]:
    """Test and validation rows of a class of `n`."""
    test = F.floor((n * TEST_TENTHS + 5) / 10)
    return test, F.floor((n - test + VALIDATION_PART // 2) / VALIDATION_PART)


def training_sets(df: DataFrame, target: int = TARGET, leaky: bool = False, seed: int = SEED) -> DataFrame:
    """Split rows, balance the training part only.

    `leaky=True` balances before splitting, so copies of one row can land in
    several parts.
    """
    if leaky:
        pool = balance(df, target, seed=seed).drop("shuffle_key")
        keyed = pool.withColumn("__row", F.col("review_id") * (target + 1) + F.col("draw"))
        return stratified_split(keyed, row_id="__row", seed=seed).drop("__row")
    parts = stratified_split(df, seed=seed)
    train = balance(parts.filter("split = 'train'"), target, seed=seed).drop("shuffle_key")
    rest = parts.filter("split <> 'train'").withColumn("draw", F.lit(1).cast("long"))
    return train.unionByName(rest)


def training_part(df: DataFrame, target: int = TARGET, label: str = "reviewRating", row_id: str = "review_id", seed: int = SEED) -> DataFrame:
    """The training rows of `training_sets` alone.

    Split and draw rank by the same key, so the drawn rows are those that follow the held-out ones, and only buckets that
    hold such rows are moved. At most `target` per class, they come in one partition, so that sums over them do not depend
    on the cluster.
    """

    def train(n):
        test, val = _held_out(n)
        return test + val, test + val + target

    picked = settled(ranked(df.filter(F.col(label).isNotNull()), label, row_id, seed, within=train), "picked")
    low = train(F.col("group_rows"))[0]
    picked = picked.withColumns({"rank": F.col("rank") - low, "group_rows": F.col("group_rows") - low})
    drawn = _draws(picked, df.columns, target, label, row_id, seed).drop("shuffle_key").coalesce(1)
    return drawn.select(*df.columns, F.lit("train").alias("split"), "draw")


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows (stat, key, value): totals, means, and counts per rating and provider."""
    totals = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_reviews"),
        F.avg("reviewRating").alias("avg_rating"),
        F.avg("text_length").alias("avg_text_length"),
    )
    names = ["total_reviews", "avg_rating", "avg_text_length"]
    parts = [
        totals.select(F.lit("all").alias("key"), *names).unpivot("key", names, "stat", "value")
        .select("stat", "key", F.round("value", 6).alias("value"))
    ]
    for stat, column in (("rating_distribution", "reviewRating"), ("provider_distribution", "provider")):
        if column in df.columns:
            parts.append(
                df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key"))
                .agg(F.count(F.lit(1)).cast("double").alias("value"))
                .select(F.lit(stat).alias("stat"), "key", "value")
            )
    return reduce(DataFrame.unionByName, parts)
