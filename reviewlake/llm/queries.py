"""Registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import clustering, decontamination, fingerprints, jaccard_join, packing, pii, pitman_yor, prefix_trie, quality, sharding, suffix_dedup, token_counts, toxicity
from reviewlake.llm.common import shipped

Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    return lambda spark, folder: query(shipped(spark), folder)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": _ready(suffix_dedup.op1_suffix_dedup),
    "op2_pitman_yor": _ready(pitman_yor.op2_pitman_yor),
    "op3_token_counts": _ready(token_counts.op3_token_counts),
    "op4_toxicity": _ready(toxicity.op4_toxicity),
    "op5_jaccard_join": _ready(jaccard_join.op5_jaccard_join),
    "op6_packing": _ready(packing.op6_packing),
    "op7_decontamination": _ready(decontamination.op7_decontamination),
    "op8_sharding": _ready(sharding.op8_sharding),
    "op9_quality": _ready(quality.op9_quality),
    "op10_fingerprints": _ready(fingerprints.op10_fingerprints),
    "op11_prefix_trie": _ready(prefix_trie.op11_prefix_trie),
    "op12_pii": _ready(pii.op12_pii),
    "op13_centroid_clustering": _ready(clustering.op13_centroid_clustering),
}
ORACLES: dict[str, str] = {
    "op11_prefix_trie": prefix_trie.oracle_sql(),
    "op12_pii": pii.oracle_sql(),
    "op13_centroid_clustering": clustering.oracle_sql(),
}
