"""Pattern-based sarcasm score and the correction of a positive label.

All weights are DOUBLE: 0.4 + 0.2 exceeds 0.6 in binary, and the rule relies on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.search import searcher

THRESHOLD = 0.6
# A text without the words a pattern begins with cannot match it. Looking for
# them first is a plain byte search, and few texts then reach the regex.
BEGINNINGS = ("oh ", "just ", "yeah", "of course", "obviously", "clearly")
_search, _found = searcher((*BEGINNINGS, *lx.SARCASM_CONTEXT, *lx.SARCASM_POSITIVE))


def line_pattern(pattern: str) -> str:
    """`.` spelled out as "anything but a line feed", which engines agree on."""
    return pattern.replace(".*", "[^\\n]*")


def score(text: Column, text_lc: Column) -> Column:
    seen = _found(_search(text_lc))
    patterns = F.lit(0)
    for beginning, pattern in zip(BEGINNINGS, lx.SARCASM_PATTERNS, strict=True):
        found = seen.any_hit([beginning]) & text_lc.rlike(line_pattern(pattern))
        patterns = patterns + found.cast("int")
    context = seen.n_hits(lx.SARCASM_CONTEXT)
    contrast = seen.any_hit(lx.SARCASM_POSITIVE) & (context >= 2)
    shouting = text.contains("!") & (context > 0)
    return (
        patterns.cast("double") * F.lit(0.4)
        + F.when(contrast, F.lit(0.5)).otherwise(F.lit(0.0))
        + F.when(shouting, F.lit(0.2)).otherwise(F.lit(0.0))
    )


def is_sarcastic(raw_score: Column) -> Column:
    return raw_score > F.lit(THRESHOLD)


def confidence(raw_score: Column) -> Column:
    return F.round(F.least(raw_score, F.lit(1.0)), 3)


def corrected(label: Column, sarcastic: Column) -> Column:
    return F.when(sarcastic & label.isin("positive", "amazing"), "negative").otherwise(label)
