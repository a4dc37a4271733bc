"""Reference SQL: named table expressions and a resolver that prefixes a query with them."""

from __future__ import annotations

import re

from reviewlake.functions import lexicons as lx
from reviewlake.sources import phrases as ph

CTES: dict[str, str] = {}


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]::VARCHAR[]"


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def with_ctes(body: str) -> str:
    """Prefix `body` with every table expression it needs, directly or not."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", sql):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED (\n{CTES[name]}\n)" for name in order)
    return f"WITH {parts}\n{body.strip()}"


def count_hits(text: str, phrases) -> str:
    return "len(list_filter(" + sql_list(phrases) + f", lambda p: contains({text}, p)))"


def rounded(x: str, digits: int) -> str:
    """Half-up rounding of the printed value of a double, as Spark rounds."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


def pick(options, index: str) -> str:
    return f"({sql_list(options)})[(({index}) % {len(options)}) + 1]"


_openers = "CASE " + " ".join(
    f"WHEN rating = {r} THEN {pick(ph.OPENERS[r], 'id // 3')}" for r in sorted(ph.OPENERS)
) + " END"

_rating = (
    "CASE WHEN k < 650 THEN 5 WHEN k < 786 THEN 4 WHEN k < 852 THEN 3 "
    "WHEN k < 882 THEN 2 ELSE 1 END"
)

cte("base_keyed", """
SELECT o_orderkey AS id, (o_orderkey * 7919 + o_custkey * 104729) % 1000 AS k,
       n_name AS place, r_name AS address, c_name AS author, CAST(o_orderdate AS DATE) AS day,
       NULL::VARCHAR AS doc_text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 2000000000 + doc_id, (doc_id * 7919 + n_chars * 104729) % 1000, source, lang,
       'reader ' || (doc_id % 997), DATE '1995-01-01' + CAST((doc_id * 37) % 2400 AS INTEGER), text
FROM documents
""")
cte("base_rated", f"SELECT *, {_rating} AS rating FROM base_keyed")
cte("base_reviews", f"""
SELECT id, k, place AS "placeName", address AS "placeAddress",
       CASE WHEN doc_text IS NULL THEN {pick(ph.PROVIDERS, 'id')}
            ELSE {pick(ph.PROVIDERS, 'id - 2000000000')} END AS provider,
       CASE WHEN doc_text IS NOT NULL THEN doc_text ELSE
         {_openers} || ' ' || {pick(ph.FIRST_CLAUSES, 'id * 31 + 7')}
         || {pick(ph.CONNECTORS, 'id // 5')} || {pick(ph.SECOND_CLAUSES, 'id * 17 + 3')}
         || '.' || {pick(ph.TAILS, 'id // 7')} END AS "reviewText",
       day AS "reviewDate", rating AS "reviewRating", author AS "authorName"
FROM base_rated
""")
cte("reviews_v", """
SELECT id AS review_id, "placeName", "placeAddress", provider, "reviewText", "reviewDate",
       "reviewRating", "authorName"
FROM base_reviews
""")

_defects = {
    "placeName": "CASE WHEN o AND id % 307 = 1 THEN NULL ELSE \"placeName\" END",
    "placeAddress": '"placeAddress"',
    "provider": "provider",
    "reviewText": """CASE WHEN o AND id % 101 = 0 THEN NULL WHEN o AND id % 103 = 0 THEN '   '
        WHEN o AND id % 59 = 0 THEN 'ok'
        WHEN o AND id % 53 = 0 THEN "reviewText" || ' <b>Look</b> at http://example.com/r/' || id
        ELSE "reviewText" END""",
    "reviewDate": """CASE WHEN o AND id % 307 = 0 THEN 'not a date' WHEN o AND id % 311 = 0 THEN '1985-06-01'
        WHEN o AND id % 313 = 0 THEN '2099-01-01' ELSE CAST("reviewDate" AS VARCHAR) END""",
    "reviewRating": """CASE WHEN o AND k % 97 = 0 THEN NULL WHEN o AND id % 211 = 0 THEN '9'
        WHEN o AND id % 223 = 0 THEN 'bad' WHEN o AND id % 227 = 0 THEN '4.5'
        ELSE CAST("reviewRating" AS VARCHAR) END""",
    "authorName": '"authorName"',
}
cte("raw_v", "SELECT id + c AS review_id, " + ", ".join(
    f"CASE WHEN o AND id % 509 = 0 THEN '{c}' ELSE {_defects[c]} END AS \"{c}\"" for c in lx.REVIEW_COLUMNS
) + """
FROM (SELECT *, id < 1000000000 AS o FROM base_reviews) b,
     (VALUES (0), (1000000000)) AS copies(c)
WHERE c = 0 OR (o AND id % 401 = 0)
""")
cte("scored_v", """
SELECT id AS review_id, "placeName", "placeAddress", provider, "reviewText", "reviewDate", "reviewRating",
       "authorName", "reviewRating" AS y,
       greatest(1, least(5, CASE id % 7 WHEN 0 THEN "reviewRating" - 1 WHEN 1 THEN "reviewRating" + 1
                            ELSE "reviewRating" END)) AS p,
       (400 + k % 600) / 1000.0::DOUBLE AS confidence
FROM base_reviews
""")
cte("inbox_v", """
SELECT * REPLACE (CASE WHEN review_id < 1000000000 AND review_id % 101 = 0 THEN NULL
                       ELSE "reviewText" END AS "reviewText")
FROM scored_v
""")
