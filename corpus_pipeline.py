"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, folder) and returns a frame; run() writes it as Parquet to the shared folder and reads it
back as the next stage's documents. Stages see the columns of `documents` only, so other columns, of whatever name, do not
reach them. Null texts count as empty; every stage gives an empty result for an empty table. Ties among near copies go to the
smallest id; a stage's operator states what it does with very long texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import decontamination, jaccard_join, packing, suffix_dedup, toxicity
from reviewlake.llm.common import settled, shipped, table, text_or_empty

#: Bytes of the repeats that go: 51 words of four letters with a blank each reach it, so every passage of over 50 words does.
PASSAGE = 250
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects documents whose toxic score is 0.7 or more."""
    docs = docs.select(*COLUMNS)
    body = docs.select("doc_id", text_or_empty().alias("text"))
    scorer = toxicity.fit(body, toxicity.labelled(spark, folder, "toxic"), ~toxicity.held_out())
    return toxicity.score(docs, scorer).filter(F.col("toxic_score") < toxicity.CUT).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages of `PASSAGE` bytes and more that stand elsewhere too; every document stays."""
    cut = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), length=PASSAGE)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects documents with a window of similarity 0.8 or more to a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(settled(packing.pieces(docs), "pieces"))


def _ready(stage):
    return lambda spark, docs, folder: stage(shipped(spark), docs, folder)


STAGES = [
    ("toxicity", _ready(without_toxic)),
    ("jaccard_join", _ready(one_of_each)),
    ("suffix_dedup", _ready(without_repeats)),
    ("decontamination", _ready(without_benchmark)),
    ("packing", _ready(packed)),
]
#: Tokens, fingerprints and a fitted model are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
