"""Reference SQL of sources, cleaning, features, validation, anomalies and bias."""

from __future__ import annotations

from reviewlake.functions import lexicons as lx
from reviewlake.oracles.base import cte, quote, sql_list, with_ctes

SPACE_CHARS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def clean(t: str) -> str:
    t = f"lower(coalesce({t}, ''))"
    t = f"regexp_replace({t}, 'http{NON_SPACE}+|www[^\\n]{NON_SPACE}+', '', 'g')"
    t = f"regexp_replace({t}, '<[^\\n]*?>', '', 'g')"
    t = f"regexp_replace({t}, '[^a-zA-Z0-9.,!?{SPACE_CHARS}]', '', 'g')"
    return squeeze(t)


def label(rating: str, labels=lx.LABELS_EXCELLENT) -> str:
    whens = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(labels, 1))
    return f"CASE {rating} {whens} ELSE 'unknown' END"


STOCK = "CASE r " + " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in lx.RATING_TEXTS.items()) + " ELSE '' END"
BLANK = f"""("reviewText" IS NULL OR regexp_matches("reviewText", '^{SPACE}*$'))"""
HEADER = " OR ".join(f"coalesce(\"{c}\" = '{c}', false)" for c in lx.REVIEW_COLUMNS)
COLS = ", ".join(f'"{c}"' for c in lx.REVIEW_COLUMNS)
TYPED_COLUMNS = (*lx.REVIEW_COLUMNS, "text_length")

cte("headless_v", f"SELECT * FROM raw_v WHERE NOT ({HEADER})")
cte("typed_v", """
SELECT * REPLACE (CAST(trunc(try_cast("reviewRating" AS DOUBLE)) AS INTEGER) AS "reviewRating",
                  try_cast("reviewDate" AS DATE) AS "reviewDate"),
       length("reviewText") AS text_length
FROM headless_v
""")
cte("clean_v", f"""
SELECT review_id, "placeName", "placeAddress", provider,
       {clean(f'CASE WHEN {BLANK} THEN {STOCK} ELSE "reviewText" END')} AS "reviewText",
       try_cast("reviewDate" AS DATE) AS "reviewDate", r AS "reviewRating", "authorName"
FROM (SELECT *, CAST(trunc(x) AS INTEGER) AS r
      FROM (SELECT *, try_cast("reviewRating" AS DOUBLE) AS x FROM headless_v) WHERE x BETWEEN 1 AND 5)
""")
cte("feature_v", f"""
SELECT c.*, length(c."reviewText") AS text_length, {label('c."reviewRating"')} AS sentiment, restaurant_avg_rating
FROM clean_v c LEFT JOIN (
  SELECT "placeName" AS pn, avg("reviewRating") AS restaurant_avg_rating FROM clean_v
  WHERE "placeName" IS NOT NULL GROUP BY ALL) m ON c."placeName" = m.pn
""")


def missing(view: str, columns, ids: bool = False) -> str:
    parts = []
    for c in columns:
        first = f""", (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM
            (SELECT review_id AS i FROM {view} WHERE "{c}" IS NULL ORDER BY 1 LIMIT 10)) AS ids""" if ids else ""
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) AS missing_count,
            coalesce(round(count(*) FILTER ("{c}" IS NULL) * 100.0::DOUBLE / nullif(count(*), 0), 2), 0) AS missing_percentage,
            {str(c in lx.CRITICAL_COLUMNS).lower()} AS is_critical{first} FROM {view}""")
    return "\nUNION ALL ".join(parts)


def flagged(view: str, condition: str, anomaly: str, subject: str) -> str:
    return f"""SELECT '{anomaly}' AS anomaly, '{subject}' AS subject, count(*) AS count, NULL::DOUBLE AS percentage,
      (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM
        (SELECT review_id AS i FROM {view} WHERE {condition} ORDER BY 1 LIMIT 10)) AS ids, NULL::VARCHAR AS detail
      FROM {view} WHERE {condition} HAVING count(*) > 0"""


def dup_groups(view: str, columns) -> str:
    cols = ", ".join(f'"{c}"' for c in columns)
    return f"""SELECT review_id, count(*) OVER (PARTITION BY {cols}) AS n FROM {view}"""


def dup_anomaly(view: str, columns, subject: str) -> str:
    g = dup_groups(view, columns)
    return f"""SELECT 'duplicates' AS anomaly, '{subject}' AS subject,
      (SELECT count(*) FROM ({g}) WHERE n > 1) AS count, NULL::DOUBLE AS percentage,
      (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM
        (SELECT review_id AS i FROM ({g}) WHERE n > 1 ORDER BY 1 LIMIT 10)) AS ids, NULL::VARCHAR AS detail"""


def zscore(view: str, columns) -> str:
    return "\nUNION ALL ".join(
        flagged(view, f"""abs("{c}" - (SELECT avg("{c}") FROM {view})) > 3 * (SELECT stddev_pop("{c}") FROM {view})""",
                "numeric_outliers", c)
        for c in columns
    )


def dominance(view: str) -> str:
    return f"""SELECT 'rating_anomalies' AS anomaly, 'rating_imbalance' AS subject, n AS count,
      round(n * 100.0::DOUBLE / total, 2) AS percentage, NULL::VARCHAR AS ids, r::VARCHAR AS detail
      FROM (SELECT "reviewRating" AS r, count(*) AS n, (SELECT count("reviewRating") FROM {view}) AS total
            FROM {view} WHERE "reviewRating" IS NOT NULL GROUP BY 1 ORDER BY n DESC, r LIMIT 1)
      WHERE n > 0.8::DOUBLE * total"""


TEMPLATES = """SELECT 'repeated_templates' AS anomaly, 'reviewText' AS subject, n AS count, NULL::DOUBLE AS percentage,
  NULL::VARCHAR AS ids, t AS detail FROM (SELECT "reviewText" AS t, count(*) AS n FROM typed_v
  WHERE length("reviewText") < 50 GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, t LIMIT 5)"""
MISSING_ANOMALY = f"""SELECT 'missing' AS anomaly, "column" AS subject, missing_count AS count,
  missing_percentage AS percentage, ids, NULL::VARCHAR AS detail
  FROM ({missing('typed_v', TYPED_COLUMNS, ids=True)}) WHERE missing_count > 0"""
DUPLICATES = dup_anomaly("typed_v", TYPED_COLUMNS, "exact") + "\nUNION ALL " + dup_anomaly("typed_v", ["reviewText"], "text")
SHORT = flagged("typed_v", "text_length < 10", "very_short_reviews", "text_length")
DATES = (
    flagged("typed_v", "\"reviewDate\" > DATE '2002-01-01'", "date_anomalies", "future_dates")
    + "\nUNION ALL "
    + flagged("typed_v", "\"reviewDate\" < DATE '1990-01-01'", "date_anomalies", "old_dates")
)
RATINGS = flagged("typed_v", '"reviewRating" < 1 OR "reviewRating" > 5', "rating_anomalies", "invalid_ratings")

NUMERIC = ("reviewRating", "text_length", "restaurant_avg_rating")


def category(view: str, column: str) -> str:
    return f"""SELECT '{column}' AS dimension, "{column}" AS category, count(*) AS count,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM {view}), 6) AS percentage,
      round(avg("reviewRating"), 6) AS avg_rating, round(stddev_samp("reviewRating"), 6) AS rating_std
      FROM {view} WHERE "{column}" IS NOT NULL GROUP BY 2"""


def imbalance(view: str, column: str) -> str:
    g = f'SELECT "{column}" AS c, count(*) AS n FROM {view} WHERE "{column}" IS NOT NULL GROUP BY 1'
    return f"""SELECT '{column}' AS dimension, round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio,
      (SELECT c FROM ({g}) ORDER BY n DESC, c LIMIT 1) AS most_common,
      (SELECT c FROM ({g}) ORDER BY n, c LIMIT 1) AS least_common,
      (SELECT count(*) FROM {view} WHERE "{column}" IS NULL) AS null_count FROM ({g})"""


cte("bias_dist", """SELECT "reviewRating", count(*) AS count,
  round(count(*)::DOUBLE / (SELECT count("reviewRating") FROM typed_v), 6) AS share
  FROM typed_v WHERE "reviewRating" IS NOT NULL GROUP BY 1""")


def moments(view: str) -> str:
    return f"""SELECT round(avg("reviewRating"), 6) AS mean_rating,
      quantile_cont("reviewRating"::DOUBLE, 0.5) AS median_rating,
      round(stddev_samp("reviewRating"), 6) AS std_rating, round(skewness("reviewRating"), 6) AS skewness FROM {view}"""


def ratios(view: str) -> str:
    return f"""SELECT round(avg(CASE WHEN "reviewRating" >= 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_ratio,
      round(avg(CASE WHEN "reviewRating" <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_ratio,
      round(avg(CASE WHEN "reviewRating" = 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS neutral_ratio FROM {view}"""


VERDICT = """SELECT CASE WHEN avg(CASE WHEN "reviewRating" >= 4 THEN 1.0::DOUBLE ELSE 0 END) > 0.7 THEN 'positive'
  WHEN avg(CASE WHEN "reviewRating" <= 2 THEN 1.0::DOUBLE ELSE 0 END) > 0.5 THEN 'negative' ELSE 'none' END AS bias FROM {v}"""
MONTHLY = """SELECT CAST(date_trunc('month', "reviewDate") AS DATE) AS month, round(avg("reviewRating"), 6) AS mean_rating,
  round(stddev_samp("reviewRating"), 6) AS std_rating, count("reviewRating") AS count
  FROM {v} WHERE "reviewDate" IS NOT NULL GROUP BY 1"""
LENGTHS = """SELECT count(*) FILTER (text_length < 20) AS short_reviews_count,
  count(*) FILTER (text_length > cut) AS long_reviews_count,
  round(avg("reviewRating") FILTER (text_length < 20), 6) AS avg_rating_short,
  round(avg("reviewRating") FILTER (text_length > cut), 6) AS avg_rating_long
  FROM {v}, (SELECT quantile_cont(text_length, 0.9) AS cut FROM {v})"""


def long(section: str, sql: str, key: str, metrics) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, ({key})::VARCHAR AS key, '{m}' AS metric, \"{m}\"::DOUBLE AS value FROM ({sql})"
        for m in metrics
    )


_dist = """SELECT "reviewRating", count(*) AS count, round(count(*)::DOUBLE / (SELECT count("reviewRating") FROM feature_v), 6) AS share
  FROM feature_v WHERE "reviewRating" IS NOT NULL GROUP BY 1"""
BIAS_REPORT = "\nUNION ALL ".join([
    long("rating_distribution", _dist, '"reviewRating"', ["count", "share"]),
    long("rating_moments", moments("feature_v"), "'all'", ["mean_rating", "median_rating", "std_rating", "skewness"]),
    long("rating_ratios", ratios("feature_v"), "'all'", ["positive_ratio", "negative_ratio", "neutral_ratio"]),
    long("text_length", LENGTHS.format(v="feature_v"), "'all'",
         ["short_reviews_count", "long_reviews_count", "avg_rating_short", "avg_rating_long"]),
    *[long(c, category("feature_v", c), "category", ["count", "percentage", "avg_rating", "rating_std"]) for c in ("sentiment", "placeName")],
    *[long(f"{c}_imbalance", imbalance("feature_v", c), "'all'", ["imbalance_ratio", "null_count"]) for c in ("sentiment", "placeName")],
    long("monthly_trend", MONTHLY.format(v="feature_v"), "strftime(month, '%Y-%m')", ["mean_rating", "std_rating", "count"]),
    f"SELECT 'verdict', bias, 'bias', 1.0::DOUBLE FROM ({VERDICT.format(v='feature_v')})",
])

_gate_dups = dup_groups("feature_v", (*lx.REVIEW_COLUMNS, "text_length", "sentiment", "restaurant_avg_rating"))

SQL = {
    "scan_reviews": "SELECT * FROM raw_v",
    "json_source": "SELECT * FROM raw_v",
    "required_columns": f"""SELECT c AS "column", true AS present, (SELECT count(*) FROM raw_v) AS rows
        FROM (SELECT unnest({sql_list(lx.REQUIRED_COLUMNS)}) AS c)""",
    "ingest_profile": "SELECT count(*) AS rows, '" + ",".join(lx.REVIEW_COLUMNS) + "' AS columns, "
        + " + ".join(f'count(*) FILTER ("{c}" IS NULL)' for c in lx.REVIEW_COLUMNS) + " AS missing_values FROM raw_v",
    "review_pages_flatten": """SELECT review_id // 20 AS page_id, "authorName", "reviewRating"::DOUBLE AS "reviewRating",
        strftime("reviewDate", '%Y-%m-%d') AS "reviewDate", "reviewText" FROM reviews_v""",
    "csv_roundtrip": "SELECT * FROM clean_v",
    "report_json": missing("typed_v", TYPED_COLUMNS),
    "drop_header_rows": "SELECT * FROM headless_v",
    "numeric_coerce": """SELECT review_id, try_cast("reviewRating" AS DOUBLE) AS "reviewRating" FROM raw_v""",
    "rating_range": """SELECT * FROM (SELECT review_id, try_cast("reviewRating" AS DOUBLE) AS "reviewRating" FROM raw_v)
        WHERE "reviewRating" BETWEEN 1 AND 5""",
    "rating_int": """SELECT review_id, CAST(trunc(try_cast("reviewRating" AS DOUBLE)) AS INTEGER) AS "reviewRating" FROM raw_v""",
    "training_rows": """SELECT review_id, try_cast("reviewRating" AS DOUBLE) AS "reviewRating", length("reviewText") AS text_length
        FROM raw_v WHERE "reviewText" IS NOT NULL AND try_cast("reviewRating" AS DOUBLE) IS NOT NULL""",
    "impute_text": f"""SELECT review_id, CASE WHEN {BLANK} THEN {STOCK} ELSE "reviewText" END AS "reviewText"
        FROM (SELECT *, try_cast("reviewRating" AS DOUBLE) AS r FROM raw_v)""",
    "clean_text": f"""SELECT kind, id, {clean('text')} AS clean FROM (
        SELECT 'review' AS kind, review_id AS id, "reviewText" AS text FROM raw_v
        UNION ALL SELECT 'page', page_id, html FROM pages
        UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)""",
    "clean_dates": """SELECT review_id, try_cast("reviewDate" AS DATE) AS "reviewDate" FROM raw_v""",
    "clean_lenient": f"""SELECT review_id, "placeName", "placeAddress", provider,
        {clean(f'CASE WHEN {BLANK} THEN {STOCK} ELSE "reviewText" END')} AS "reviewText",
        try_cast("reviewDate" AS DATE) AS "reviewDate", r AS "reviewRating", "authorName"
        FROM (SELECT *, CAST(trunc(try_cast("reviewRating" AS DOUBLE)) AS INTEGER) AS r FROM raw_v) WHERE r IS NOT NULL""",
    "clean_reviews": "SELECT * FROM clean_v",
    "dedup_exact": f"SELECT DISTINCT {COLS} FROM raw_v",
    "length_bounds": """SELECT review_id, length("reviewText") AS n_chars FROM raw_v WHERE length("reviewText") BETWEEN 10 AND 5000""",
    "text_length": """SELECT review_id, length("reviewText") AS text_length, coalesce(length("reviewText"), 3) AS text_length_compat FROM raw_v""",
    "rating_label": f"""SELECT review_id, "reviewRating", {label('"reviewRating"')} AS sentiment FROM typed_v""",
    "restaurant_avg": """SELECT review_id, "placeName", round(restaurant_avg_rating, 6) AS restaurant_avg_rating FROM feature_v""",
    "features": "SELECT * REPLACE (round(restaurant_avg_rating, 6) AS restaurant_avg_rating) FROM feature_v",
    "rating_to_label5": f"""SELECT review_id, prediction,
        ({sql_list(lx.LABELS_AMAZING)})[1 + greatest(0, least(4, CASE WHEN prediction BETWEEN 1 AND 5 THEN prediction - 1 ELSE prediction END))] AS label
        FROM (SELECT review_id, CAST(p + review_id % 5 - 2 AS INTEGER) AS prediction FROM scored_v)""",
    "type_check": """SELECT 'reviewRating' AS "column", 'int' AS expected, 'int' AS actual, true AS valid, (SELECT count(*) FROM feature_v) AS rows
        UNION ALL SELECT 'reviewText', 'string', 'string', true, (SELECT count(*) FROM feature_v)""",
    "rating_checks": """SELECT min("reviewRating")::DOUBLE AS min, max("reviewRating")::DOUBLE AS max,
        count(*) FILTER ("reviewRating" < 1 OR "reviewRating" > 5) AS out_of_range_count,
        min("reviewRating") >= 1 AND max("reviewRating") <= 5 AS valid FROM typed_v""",
    "length_checks": """SELECT min(text_length)::DOUBLE AS min, max(text_length)::DOUBLE AS max, round(avg(text_length), 6) AS mean,
        count(*) FILTER (text_length = 0) AS empty_count FROM typed_v""",
    "missing_report": missing("typed_v", TYPED_COLUMNS),
    "duplicate_report": f"""SELECT 'exact_duplicates' AS kind, count(*) AS rows FROM ({dup_groups('typed_v', TYPED_COLUMNS)}) WHERE n > 1
        UNION ALL SELECT 'duplicate_texts', count(*) FROM ({dup_groups('typed_v', ['reviewText'])}) WHERE n > 1""",
    "validation_gate": f"""SELECT d <= 5 AND g = 0 AS passed, d AS exact_duplicates,
        concat_ws('; ', CASE WHEN d > 5 THEN 'Exact duplicate rows found' END,
          CASE WHEN p > 0 THEN 'Critical column ''placeName'' has missing values' END,
          CASE WHEN r > 0 THEN 'Critical column ''reviewRating'' has missing values' END) AS issues
        FROM (SELECT (SELECT count(*) FROM ({_gate_dups}) WHERE n > 1) AS d, p, r, p + r AS g FROM
          (SELECT count(*) FILTER ("placeName" IS NULL) AS p, count(*) FILTER ("reviewRating" IS NULL) AS r FROM feature_v))""",
    "anom_duplicates": DUPLICATES,
    "anom_short": SHORT,
    "anom_templates": TEMPLATES,
    "anom_missing": MISSING_ANOMALY,
    "anom_zscore": zscore("feature_v", NUMERIC),
    "anom_dates": DATES,
    "anom_ratings": RATINGS,
    "anom_dominance": dominance('(SELECT toxic AS "reviewRating" FROM labels)') + " UNION ALL " + dominance("typed_v"),
    "anomaly_report": "\nUNION ALL ".join([
        DUPLICATES, zscore("typed_v", ("reviewRating", "text_length")), SHORT, f"({TEMPLATES})",
        MISSING_ANOMALY, DATES, RATINGS, dominance("typed_v")]),
    "anom_iqr": "\nUNION ALL ".join(f"""SELECT '{c}' AS subject, round(q1, 6) AS q1, round(q3, 6) AS q3,
        round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS low, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS high,
        (SELECT count(*) FROM feature_v WHERE "{c}" < q1 - 1.5::DOUBLE * (q3 - q1) OR "{c}" > q3 + 1.5::DOUBLE * (q3 - q1)) AS count
        FROM (SELECT quantile_cont("{c}"::DOUBLE, 0.25) AS q1, quantile_cont("{c}"::DOUBLE, 0.75) AS q3 FROM feature_v)""" for c in NUMERIC),
    "rating_distribution": "SELECT * FROM bias_dist",
    "rating_moments": moments("clean_v"),
    "rating_ratios": ratios("typed_v"),
    "rating_bias_verdict": VERDICT.format(v="clean_v"),
    "category_bias": category("feature_v", "sentiment") + "\nUNION ALL " + category("feature_v", "placeName"),
    "category_imbalance": imbalance("feature_v", "sentiment") + "\nUNION ALL " + imbalance("feature_v", "placeName"),
    "monthly_trend": MONTHLY.format(v="clean_v"),
    "length_bias": LENGTHS.format(v="feature_v"),
    "bias_report": BIAS_REPORT,
}


def oracle() -> dict[str, str]:
    return {key: with_ctes(sql) for key, sql in SQL.items()}
