"""Reference SQL of sampling, metrics and fairness."""

from __future__ import annotations

from reviewlake.functions import lexicons as lx
from reviewlake.operators.models import MAX_TERMS
from reviewlake.oracles.base import cte, sql_list, with_ctes
from reviewlake.plans.model_queries import ROWS_PER_RATING


def key(row_id: str, seed: int) -> str:
    return f"(({row_id} % 1000000007) * 1103515245 + {seed * 40503}) % 2147483647"


def label(c: str) -> str:
    return f"({sql_list(lx.LABELS_AMAZING)})[{c}]"


cte("ranked_v", f"""
SELECT *, row_number() OVER (PARTITION BY "reviewRating" ORDER BY k, review_id) AS rank,
  count(*) OVER (PARTITION BY "reviewRating") AS n
FROM (SELECT review_id, "reviewRating", {key('review_id', 42)} AS k FROM reviews_v)""")


def rates(source: str, groups: str = "") -> str:
    """Per class counts and rates of a query with y, p and the group columns."""
    g = groups + ", " if groups else ""
    on = " AND ".join(["a.c = b.c", *[f"a.{x} = b.{x}" for x in groups.split(", ") if x]])
    cols = "".join(f"coalesce(a.{x}, b.{x}) AS {x}, " for x in groups.split(", ") if x)
    return f"""SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
        coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1
      FROM (SELECT {cols}coalesce(a.c, b.c) AS c, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
        FROM (SELECT {g}y AS c, count(*) FILTER (y = p) AS tp, count(*) AS support FROM {source} GROUP BY ALL) a
        FULL JOIN (SELECT {g}p AS c, count(*) AS predicted FROM {source} GROUP BY ALL) b ON {on})"""


def weighted(source: str, groups: str = "") -> str:
    g = groups + ", " if groups else ""
    return f"""SELECT {g}sum(tp)::DOUBLE / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1,
      sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(support)::BIGINT AS support
      FROM ({rates(source, groups)}) GROUP BY ALL"""


def r6(sql: str, columns) -> str:
    return "SELECT * REPLACE (" + ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns) + f") FROM ({sql})"


METRICS = ("accuracy", "f1", "precision", "recall")
cte("guess_v", """SELECT y, m AS model, CASE m WHEN 'shifted' THEN p WHEN 'majority' THEN 5 ELSE least(5, y + review_id % 2) END AS p
  FROM scored_v, (VALUES ('shifted'), ('majority'), ('step_up')) AS models(m)""")
cte("tuned_v", "SELECT y, CASE WHEN review_id % 2 = 0 THEN y ELSE p END AS p FROM scored_v")
cte("point_v", """
SELECT c, score, sum(hit)::BIGINT AS pos, (count(*) - sum(hit))::BIGINT AS neg FROM (
  SELECT c, CASE WHEN p = c THEN confidence ELSE (1.0::DOUBLE - confidence) / 4.0::DOUBLE END AS score, (y = c)::INT AS hit
  FROM scored_v, (VALUES (1), (2), (3), (4), (5)) AS g(c)) GROUP BY ALL""")
cte("mark_v", """
SELECT 0 AS c, score, sum(quality)::BIGINT AS pos, (count(*) - sum(quality))::BIGINT AS neg FROM (
  SELECT quality, ((doc_id * 37 + n_chars) % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)) GROUP BY ALL""")


def cum(source: str) -> str:
    return f"""SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY c) AS tp, sum(neg) OVER (PARTITION BY c) AS tn
      FROM {source} WINDOW w AS (PARTITION BY c ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""


def auc(source: str) -> str:
    return f"SELECT c, sum(neg * (cp - pos / 2.0::DOUBLE)) / (any_value(tp)::DOUBLE * any_value(tn)) AS auc, any_value(tp) AS support FROM ({cum(source)}) GROUP BY 1"


cte("sliced_v", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS dimension, "{c}"::VARCHAR AS value, y, p FROM scored_v WHERE "{c}" IS NOT NULL"""
    for c in ("authorName", "provider", "reviewRating", "placeName")
))
cte("slice_v", f"SELECT * FROM ({weighted('sliced_v', 'dimension, value')}) WHERE support >= 10")
cte("overall_v", weighted("scored_v"))
cte("spread_v", """
SELECT dimension, metric, max(x) AS max, min(x) AS min, max(x) - min(x) AS range, stddev_pop(x) AS std, avg(x) AS mean,
  max(o) AS overall, max(abs(x - o)) AS max_deviation FROM (
""" + "\nUNION ALL ".join(f"SELECT dimension, '{m}' AS metric, {m} AS x, (SELECT {m} FROM overall_v) AS o FROM slice_v" for m in METRICS)
    + ") GROUP BY ALL")
cte("violation_v", """SELECT dimension, metric, range, 0.1::DOUBLE AS threshold,
  CASE WHEN range > 0.2::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM spread_v WHERE range > 0.1::DOUBLE""")
cte("advice_v", """SELECT severity AS priority, count(*) || ' fairness violations of severity ' || severity AS issue,
  CASE severity WHEN 'HIGH' THEN 'Train again on balanced data or with fairness constraints' ELSE 'Watch these slices and improve them one by one' END AS suggestion
  FROM violation_v GROUP BY severity
  UNION ALL SELECT DISTINCT 'MEDIUM', 'Metrics differ across ' || dimension, 'Add or reweight data for the weak values of ' || dimension FROM violation_v""")

SPREAD = ("max", "min", "range", "std", "mean", "overall", "max_deviation")


def _long(section: str, source: str, dimension: str, name: str, columns) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{section}' AS section, {dimension} AS dimension, {name} AS key, '{c}' AS metric, "{c}"::DOUBLE AS value, NULL::VARCHAR AS note FROM {source}"""
        for c in columns
    )


REPORT = "\nUNION ALL ".join([
    _long("slices", "slice_v", "dimension", "value", (*METRICS, "support")),
    _long("overall", "overall_v", "NULL::VARCHAR", "NULL::VARCHAR", (*METRICS, "support")),
    _long("disparities", "spread_v", "dimension", "metric", SPREAD),
    "SELECT 'violations', dimension, NULL, metric, range, severity FROM violation_v",
    "SELECT 'recommendations', NULL, priority, NULL, NULL, issue || ': ' || suggestion FROM advice_v",
])

# Training rows: split, then ROWS_PER_RATING draws per class of the training part.
cte("split_v", """SELECT review_id, "reviewRating", k, CASE WHEN rank <= t THEN 'test' WHEN rank <= t + (n - t + 4) // 8 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, (n * 2 + 5) // 10 AS t FROM ranked_v)""")
cte("pool_v", """SELECT review_id, "reviewRating", row_number() OVER (PARTITION BY "reviewRating" ORDER BY k, review_id) AS rank,
  count(*) OVER (PARTITION BY "reviewRating") AS n FROM split_v WHERE split = 'train'""")
cte("drawn_v", f"""
SELECT review_id, "reviewRating", rank AS draw FROM pool_v WHERE n >= {ROWS_PER_RATING} AND rank <= {ROWS_PER_RATING}
UNION ALL
SELECT review_id, "reviewRating", d FROM pool_v, (SELECT unnest(generate_series(1, {ROWS_PER_RATING})) AS d) t
WHERE n < {ROWS_PER_RATING} AND rank = (d * 7919 + 42) % n + 1""")
cte("word_v", r"""
SELECT i, split, y, regexp_extract_all(lower("reviewText"), '\w\w+') AS w FROM (
  SELECT row_number() OVER (ORDER BY split, review_id, draw) AS i, * FROM (
    SELECT 'train' AS split, review_id, "reviewRating" AS y, draw FROM drawn_v
    UNION ALL SELECT split, review_id, "reviewRating", 1 FROM split_v WHERE split = 'val') JOIN reviews_v USING (review_id))""")
cte("term_v", """
SELECT i, split, y, t, count(*) AS tf FROM (
  SELECT i, split, y, unnest(list_concat(w,
    list_transform(range(1, greatest(len(w), 1)), lambda k: w[k] || ' ' || w[k + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) AS t FROM word_v) GROUP BY ALL""")
cte("vocabulary_v", f"""
SELECT row_number() OVER (ORDER BY uses DESC, t) - 1 AS position, t, ln((n + 1)::DOUBLE / (docs + 1)) AS idf FROM (
  SELECT t, sum(tf) AS uses, count(*) AS docs, (SELECT count(*) FROM word_v WHERE split = 'train') AS n FROM term_v WHERE split = 'train' GROUP BY 1)
WHERE docs >= 2 AND docs <= 0.95::DOUBLE * n ORDER BY uses DESC, t LIMIT {MAX_TERMS}""")
cte("whole_word_v", r"""
SELECT s.review_id AS i, regexp_extract_all(lower("reviewText"), '\w\w+') AS w FROM split_v s JOIN reviews_v USING (review_id) WHERE split = 'train'""")
cte("whole_term_v", """
SELECT i, t, count(*) AS tf FROM (
  SELECT i, unnest(list_concat(w,
    list_transform(range(1, greatest(len(w), 1)), lambda k: w[k] || ' ' || w[k + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) AS t FROM whole_word_v) GROUP BY ALL""")
cte("whole_vocabulary_v", f"""
SELECT row_number() OVER (ORDER BY uses DESC, t) - 1 AS position, t, ln((n + 1)::DOUBLE / (docs + 1)) AS idf FROM (
  SELECT t, sum(tf) AS uses, count(*) AS docs, (SELECT count(*) FROM whole_word_v) AS n FROM whole_term_v GROUP BY 1)
WHERE docs >= 2 AND docs <= 0.95::DOUBLE * n ORDER BY uses DESC, t LIMIT {MAX_TERMS}""")
cte("vector_v", """
SELECT i, split, y, t, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS x FROM (
  SELECT i, split, y, t, tf * idf AS x FROM term_v JOIN vocabulary_v USING (t)) WHERE x > 0""")
cte("theta_v", """
SELECT c, t, ln(coalesce(s, 0) + 0.1::DOUBLE) - ln(sum(coalesce(s, 0)) OVER (PARTITION BY c) + 0.1::DOUBLE * count(*) OVER (PARTITION BY c)) AS theta
FROM (SELECT c, t FROM vocabulary_v, (SELECT DISTINCT "reviewRating" AS c FROM drawn_v))
LEFT JOIN (SELECT y AS c, t, sum(x) AS s FROM vector_v WHERE split = 'train' GROUP BY ALL) USING (c, t)""")
cte("bayes_v", """
SELECT w.i, w.split, w.y, arg_max(c, [prior + coalesce(s, 0), -c]) AS p FROM word_v w
CROSS JOIN (SELECT "reviewRating" AS c, ln(count(*) + 0.1::DOUBLE) AS prior FROM drawn_v GROUP BY 1)
LEFT JOIN (SELECT i, c, sum(x * theta) AS s FROM vector_v JOIN theta_v USING (t) GROUP BY ALL) USING (i, c) GROUP BY ALL""")

SQL = {
    "tfidf_terms": "SELECT position::INT AS position, t AS term, idf FROM whole_vocabulary_v",
    "train_nb": "\nUNION ALL ".join(
        f"SELECT 'MultinomialNB' AS model, '{s}' AS split, * FROM ({weighted(f"(SELECT y, p FROM bayes_v WHERE split = '{s}')")})" for s in ("train", "val")
    ),
    "balance_classes": f"""SELECT *, ({key('review_id', 43)} + draw * 104729) % 2147483647 AS shuffle_key FROM (
        SELECT review_id, "reviewRating", rank AS draw FROM ranked_v WHERE n >= 900 AND rank <= 900
        UNION ALL
        SELECT review_id, r."reviewRating", d FROM ranked_v r, (SELECT unnest(generate_series(1, 900)) AS d) t
        WHERE n < 900 AND rank = (d * 7919 + 42) % n + 1)""",
    "stratified_split": """SELECT review_id, "reviewRating", CASE WHEN rank <= t THEN 'test' WHEN rank <= t + (n - t + 4) // 8 THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, (n * 2 + 5) // 10 AS t FROM ranked_v)""",
    "dataset_stats": """SELECT 'total_reviews' AS stat, 'all' AS key, count(*)::DOUBLE AS value FROM reviews_v
        UNION ALL SELECT 'avg_rating', 'all', round(avg("reviewRating"), 6) FROM reviews_v
        UNION ALL SELECT 'avg_text_length', 'all', round(avg(length("reviewText")), 6) FROM reviews_v
        UNION ALL SELECT 'rating_distribution', "reviewRating"::VARCHAR, count(*)::DOUBLE FROM reviews_v GROUP BY 2
        UNION ALL SELECT 'provider_distribution', provider, count(*)::DOUBLE FROM reviews_v GROUP BY 2""",
    "eval_weighted": r6(weighted("scored_v"), METRICS),
    "model_leaderboard": f"""SELECT model, round(f1, 6) AS f1, model = (SELECT model FROM ({weighted('guess_v', 'model')}) ORDER BY f1 DESC, model LIMIT 1) AS is_best
        FROM ({weighted('guess_v', 'model')})""",
    "tuned_or_baseline": f"""SELECT round(b, 6) AS baseline_f1, round(t, 6) AS tuned_f1, round(t - b, 6) AS improvement, CASE WHEN t > b THEN 'tuned' ELSE 'baseline' END AS kept
        FROM (SELECT (SELECT f1 FROM ({weighted('scored_v')})) AS b, (SELECT f1 FROM ({weighted('tuned_v')})) AS t)""",
    "confusion_matrix": """SELECT a.c AS y, b.c AS p, count(s.y) AS n FROM (VALUES (1), (2), (3), (4), (5)) AS a(c) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS b(c)
        LEFT JOIN scored_v s ON s.y = a.c AND s.p = b.c GROUP BY 1, 2""",
    "per_class_metrics": f"SELECT {label('c')} AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({rates('scored_v')})",
    "avg_metrics": f"""SELECT 'weighted' AS average, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
        round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({rates('scored_v')})
        UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM ({rates('scored_v')})""",
    "ovr_auc": f"""SELECT {label('c')} AS class, round(auc, 6) AS auc FROM ({auc('point_v')})
        UNION ALL SELECT 'macro', round(avg(auc), 6) FROM ({auc('point_v')})
        UNION ALL SELECT 'weighted', round(sum(auc * support) / sum(support), 6) FROM ({auc('point_v')})
        UNION ALL SELECT 'quality', round(auc, 6) FROM ({auc('mark_v')})""",
    "roc_points": f"""SELECT c AS class, round(score, 6) AS threshold, round(cn::DOUBLE / tn, 6) AS fpr, round(cp::DOUBLE / tp, 6) AS tpr FROM ({cum('point_v')})
        UNION ALL SELECT DISTINCT c, NULL, 0, 0 FROM point_v""",
    "error_sample": f"""SELECT review_id, left("reviewText", 200) || '...' AS text, {label('y')} AS true_label, {label('p')} AS predicted_label
        FROM (SELECT *, {key('review_id', 42)} AS k FROM scored_v) WHERE y <> p ORDER BY k, review_id LIMIT 10""",
    "confidence_summary": """SELECT round(avg(confidence), 6) AS overall_mean_conf, round(avg(confidence) FILTER (y = p), 6) AS correct_mean_conf,
        round(avg(confidence) FILTER (y <> p), 6) AS incorrect_mean_conf, count(*) FILTER (confidence < 0.5::DOUBLE) AS low_conf_samples,
        count(*) FILTER (confidence > 0.9::DOUBLE) AS high_conf_samples FROM scored_v""",
    "confidence_histogram": """SELECT b AS bin, count(confidence) AS count FROM (SELECT unnest(generate_series(0, 29)) AS b)
        LEFT JOIN (SELECT confidence, least(29, floor((confidence - lo) * 30 / (hi - lo)))::INT AS slot
                   FROM scored_v, (SELECT min(confidence) AS lo, max(confidence) AS hi FROM scored_v)) ON b = slot GROUP BY 1""",
    "slice_metrics": r6("SELECT * FROM slice_v", METRICS),
    "overall_metrics": r6("SELECT * FROM overall_v", METRICS),
    "slice_disparity": r6("SELECT * FROM spread_v", SPREAD),
    "fairness_violations": r6("SELECT * FROM violation_v", ["range"]),
    "fairness_recommendations": "SELECT * FROM advice_v",
    "fairness_report": r6(REPORT, ["value"]),
}


def oracle() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in SQL.items()}
