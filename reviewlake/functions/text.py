"""Text expressions shared by the operators. Every function returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.lexicons import NON_SPACE, OTHER_SPACE, SPACE

WORD = r"[\p{L}\p{N}_]+"
# All but a-z, 0-9, blank and `.,!?` in lower-case text. Written as "outside
# printable ASCII, or one of these": one range and one bit set, which measured
# fifteen times faster than the negated list of what is kept.
DROPPED = r"""[[^ -~]"#$%&'()*+/:;<=>@\[\\\]^_`{|}~-]+"""


def strings(values: Sequence[str]) -> Column:
    """A literal array<string>, folded to one constant by the optimizer."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def hits(text_lc: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the (already lower-cased) text, in list order."""
    return F.filter(strings(phrases), lambda p: text_lc.contains(p))


def n_hits(text_lc: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur; each counts once.

    A sum of plain `contains` stays inside generated code, unlike a lambda.
    """
    total = F.lit(0)
    for phrase in phrases:
        total = total + text_lc.contains(phrase).cast("int")
    return total


def any_hit(text_lc: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text_lc.contains(phrase)
    return found


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _one_blank(text: Column) -> Column:
    """Each run of white space becomes one blank; single blanks are not touched."""
    return F.regexp_replace(text, f"(?: {SPACE}|{OTHER_SPACE}){SPACE}*", " ")


def squeeze(text: Column) -> Column:
    """Collapse white space and strip the ends."""
    return F.trim(_one_blank(text))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only; stops at the first other character."""
    return text.isNull() | ~text.rlike(NON_SPACE)


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), ""))


def word_runs(text_lc: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(text_lc, F.lit(f"({WORD})"), 1)


def plain_words(text_lc: Column) -> Column:
    """Distinct whole words made of at least four letters a-z."""
    return F.array_distinct(F.regexp_extract_all(text_lc, F.lit(r"(?<![\p{L}\p{N}_])([a-z]{4,})(?![\p{L}\p{N}_])"), 1))


def clean_text(text: Column) -> Column:
    """Lower-case, drop links and tags, keep letters, digits, blanks and `.,!?`.

    One chain, so nothing is evaluated twice. White space is made plain before
    the last class, which then needs ASCII members only.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, rf"http{NON_SPACE}+|www[^\n]{NON_SPACE}+", "")
    t = F.regexp_replace(t, r"<[^\n]*?>", "")
    t = F.regexp_replace(_one_blank(t), DROPPED, "")
    return F.trim(F.regexp_replace(t, "  +", " "))


def join_list(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)
