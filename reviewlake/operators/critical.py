"""Critical issues: keyword categories, severity, actions and escalation.

Expressions over the lower-cased text, so a whole corpus is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import lexicons as lx
from reviewlake.functions.search import Found, searcher
from reviewlake.functions.text import any_hit, hits, strings

ESCALATION_NOTES = {
    "health_violation": "hygiene: close the kitchen until inspected",
    "safety": "premises: remove the hazard",
    "discrimination": "conduct: take statements and inform counsel",
    "theft_fraud": "money: compare receipts and recordings",
    "extreme_negative": "guest lost: owner to answer in person",
}


_search, _found = searcher([p for rule in lx.CRITICAL_ISSUES.values() for p in (*rule["keywords"], *rule["exclusions"])])


def category_hit(text_lc: Column, found: Found, category: str, match: str = "substring") -> Column:
    """Whether a keyword occurs; one exclusion word silences the whole category.

    `match="word"` asks for whole words, so that "chair" is no "hair".
    """
    rule = lx.CRITICAL_ISSUES[category]
    if match == "word":
        hit = text_lc.rlike(r"\b(?:" + "|".join(rule["keywords"]) + r")\b") if rule["keywords"] else F.lit(False)
    else:
        hit = found.any_hit(rule["keywords"])
    return hit & ~found.any_hit(rule["exclusions"])


def matched_keywords(text_lc: Column, category: str) -> Column:
    rule = lx.CRITICAL_ISSUES[category]
    return F.when(~any_hit(text_lc, rule["exclusions"]), hits(text_lc, rule["keywords"])).otherwise(strings([]))


def issues(text_lc: Column) -> Column:
    """Found categories in fixed order: array<struct<category, matched_keywords, severity, action>>."""
    found = [
        F.struct(
            F.lit(name).alias("category"),
            matched_keywords(text_lc, name).alias("matched_keywords"),
            F.lit(rule["severity"]).alias("severity"),
            F.lit(rule["action"]).alias("action"),
        )
        for name, rule in lx.CRITICAL_ISSUES.items()
    ]
    return F.filter(F.array(*found), lambda x: F.size(x["matched_keywords"]) > 0)


def categories(text_lc: Column, match: str = "substring") -> Column:
    """Names of the found categories, from one search for all keywords."""
    found = _found(_search(text_lc))
    return F.array_compact(
        F.array(*[F.when(category_hit(text_lc, found, c, match), F.lit(c)) for c in lx.CRITICAL_ISSUES])
    )


def severity(found: Column) -> Column:
    """`critical`, `high` or `normal`, from the found categories."""
    def level(name: str) -> Column:
        return F.arrays_overlap(found, strings([c for c, r in lx.CRITICAL_ISSUES.items() if r["severity"] == name]))

    return F.when(level("critical"), "critical").when(level("high"), "high").otherwise("normal")


def actions(found: Column) -> Column:
    """Distinct required actions, sorted."""
    table = F.create_map(*[F.lit(x) for c, r in lx.CRITICAL_ISSUES.items() for x in (c, r["action"])])
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: table[c])))


def has_issue(found: Column) -> Column:
    return F.size(found) > 0


def escalate(found: Column) -> Column:
    return severity(found) == "critical"


def escalation(found: Column, notes: dict[str, str] | None = None) -> Column:
    """Notes of all found categories, null without an issue."""
    table = F.create_map(*[F.lit(x) for pair in (notes or ESCALATION_NOTES).items() for x in pair])
    return F.when(has_issue(found), F.array_join(F.transform(found, lambda c: table[c]), " | "))
