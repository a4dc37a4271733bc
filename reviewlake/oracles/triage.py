"""Reference SQL of triage, replies, reply quality and run aggregates."""

from __future__ import annotations

from reviewlake.functions import lexicons as lx
from reviewlake.operators.critical import ESCALATION_NOTES
from reviewlake.operators.replies import DEFAULT_BOOK as BOOK
from reviewlake.oracles.base import count_hits, cte, pick, quote, rounded, sql_list, with_ctes
from reviewlake.oracles.prep import SPACE, squeeze
from reviewlake.plans.triage_queries import EXAMPLES

POS, NEG = sql_list(lx.POSITIVE_LABELS), sql_list(lx.NEGATIVE_LABELS)


def some(text: str, phrases) -> str:
    return f"({count_hits(text, phrases)} > 0)" if phrases else "false"


def label5(p: str) -> str:
    return (f"({sql_list(lx.LABELS_AMAZING)})[1 + greatest(0, least(4, "
            f"CASE WHEN {p} BETWEEN 1 AND 5 THEN {p} - 1 ELSE {p} END))]")


def issue_ctes(suffix: str, source: str) -> None:
    cte(f"lower_{suffix}", f'SELECT *, lower("reviewText") AS lc FROM {source}')
    cte(f"issue_{suffix}", "\nUNION ALL ".join(
        f"""SELECT review_id, {i} AS o, '{c}' AS category,
            list_filter({sql_list(r['keywords'])}, lambda k: contains(lc, k)) AS kw, '{r['severity']}' AS severity, '{r['action']}' AS action
            FROM lower_{suffix} WHERE {some('lc', r['keywords'])} AND NOT {some('lc', r['exclusions'])}"""
        for i, (c, r) in enumerate(lx.CRITICAL_ISSUES.items())
    ))
    patterns = " + ".join(
        f"regexp_matches(lc, {quote(p.replace('.*', chr(91) + '^' + chr(92) + 'n]*'))})::INT" for p in lx.SARCASM_PATTERNS
    )
    cte(f"label_{suffix}", f"""
SELECT *, CASE WHEN sarcastic AND original_sentiment IN ('positive', 'amazing') THEN 'negative' ELSE original_sentiment END AS corrected_sentiment,
  CASE WHEN n_issues > 0 THEN 'terrible' WHEN sarcastic AND original_sentiment IN ('positive', 'amazing') THEN 'negative'
       ELSE original_sentiment END AS sentiment
FROM (SELECT *, sscore > 0.6::DOUBLE AS sarcastic, round(least(sscore, 1.0::DOUBLE), 3) AS sarcasm_confidence FROM (
  SELECT l.*, coalesce(x.n_issues, 0) AS n_issues, coalesce(x.categories, '') AS categories,
    coalesce(x.severity, 'normal') AS severity, x.actions,
    {label5('p')} AS original_sentiment,
    ({patterns})::DOUBLE * 0.4::DOUBLE
    + CASE WHEN {some('lc', lx.SARCASM_POSITIVE)} AND {count_hits('lc', lx.SARCASM_CONTEXT)} >= 2 THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN contains("reviewText", '!') AND {count_hits('lc', lx.SARCASM_CONTEXT)} > 0 THEN 0.2::DOUBLE ELSE 0 END AS sscore
  FROM lower_{suffix} l LEFT JOIN (
    SELECT review_id, count(*) AS n_issues, string_agg(category, '|' ORDER BY o) AS categories,
      CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'high' END AS severity,
      array_to_string(list_sort(list_distinct(list(action))), '|') AS actions
    FROM issue_{suffix} GROUP BY 1) x USING (review_id)))
""")


issue_ctes("s", "scored_v")
issue_ctes("i", "inbox_v")

_marker = "CASE " + " ".join(f"WHEN contains(lc, '{m}') THEN '{m}'" for m in lx.CONTRAST_MARKERS) + " END"


def clause_ctes(suffix: str, source: str) -> None:
    cte(f"clause_{suffix}", f"""
SELECT review_id, no - 1 AS clause_no, parts[no] AS clause, lower(parts[no]) AS clc FROM (
  SELECT review_id, parts, unnest(generate_series(1, len(parts))) AS no FROM (
    SELECT review_id, CASE WHEN m IS NULL THEN ["reviewText"]
      ELSE string_split("reviewText", substr("reviewText", strpos(lc, m), length(m))) END AS parts
    FROM (SELECT review_id, "reviewText", lc, {_marker} AS m FROM {source} WHERE "reviewText" IS NOT NULL)))
""")
    cte(f"token_{suffix}", token_sql(f"SELECT review_id, clause_no AS part, clc AS t FROM clause_{suffix}"))
    cte(f"sign_{suffix}", sign_sql(f"token_{suffix}"))
    cte(f"score_{suffix}", f"""
SELECT *, CASE WHEN raw > 0.1::DOUBLE THEN 'positive' WHEN raw < -0.1::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment,
  round(raw, 3) AS score, round(least((pw + nw) / 5.0::DOUBLE, 1.0::DOUBLE), 3) AS confidence
FROM (SELECT c.*, coalesce(pw, 0) AS pw, coalesce(nw, 0) AS nw,
        CASE WHEN coalesce(pw + nw, 0) > 0 THEN (pw - nw)::DOUBLE / (pw + nw) ELSE 0 END AS raw
      FROM clause_{suffix} c LEFT JOIN (
        SELECT review_id, part, count(*) FILTER (sgn > 0) AS pw, count(*) FILTER (sgn < 0) AS nw FROM sign_{suffix} GROUP BY ALL
      ) g ON c.review_id = g.review_id AND c.clause_no = g.part)
""")
    cte(f"mention_{suffix}", "\nUNION ALL ".join(
        f"SELECT review_id, clause_no, {i} AS o, '{a}' AS aspect, score, confidence FROM score_{suffix} WHERE {some('clc', kw)}"
        for i, (a, kw) in enumerate(lx.ASPECT_KEYWORDS.items())
    ))
    cte(f"aspect_{suffix}", f"""
SELECT r.review_id, g.o, g.aspect, coalesce(num, 0) AS num_mentions,
  CASE WHEN num IS NULL THEN 'not_mentioned' WHEN mean > 0.2::DOUBLE THEN 'positive' WHEN mean < -0.2::DOUBLE THEN 'negative' ELSE 'neutral' END AS sentiment,
  coalesce(round(mean, 3), 0) AS score, coalesce(round(sure, 3), 0) AS confidence
FROM (SELECT review_id FROM {source} WHERE "reviewText" IS NOT NULL) r
CROSS JOIN (VALUES {', '.join(f"({i}, '{a}')" for i, a in enumerate(lx.ASPECTS))}) AS g(o, aspect)
LEFT JOIN (SELECT review_id, aspect, count(*) AS num, sum(score ORDER BY clause_no) / count(*) AS mean,
             sum(confidence ORDER BY clause_no) / count(*) AS sure FROM mention_{suffix} GROUP BY ALL) m
  ON r.review_id = m.review_id AND g.aspect = m.aspect
""")

    def names(test: str) -> str:
        return f"coalesce(list(aspect ORDER BY o) FILTER ({test}), []::VARCHAR[])"

    cte(f"pattern_{suffix}", f"""
SELECT *, len(pos) > 0 AND len(neg) > 0 AS has_conflict,
  CASE WHEN len(men) = 0 THEN 'no_aspects_mentioned' WHEN len(pos) > 0 AND len(neg) > 0 THEN 'mixed_sentiment'
       WHEN len(neg) >= 2 THEN 'multiple_issues' WHEN len(pos) >= 3 THEN 'highly_positive'
       WHEN len(neg) = 1 THEN 'single_issue' ELSE 'neutral_or_positive' END AS pattern,
  CASE WHEN overall > 0.3::DOUBLE THEN 'positive' WHEN overall < -0.3::DOUBLE THEN 'negative' ELSE 'neutral' END AS aspect_overall
FROM (SELECT review_id, {names("sentiment = 'positive'")} AS pos, {names("sentiment = 'negative'")} AS neg,
        {names("sentiment = 'neutral'")} AS neu, {names("num_mentions > 0")} AS men,
        arg_max(aspect, [abs(score) * confidence, -o]) FILTER (num_mentions > 0) AS dominant_aspect,
        coalesce(list(aspect ORDER BY score, o) FILTER (sentiment = 'negative'), []::VARCHAR[]) AS priority_aspects,
        coalesce(sum(score ORDER BY o) FILTER (num_mentions > 0) / count(*) FILTER (num_mentions > 0), 0) AS overall
      FROM aspect_{suffix} GROUP BY 1)
""")


def token_sql(texts: str) -> str:
    return f"""
SELECT review_id, part, i AS pos, toks[i] AS tok FROM (
  SELECT review_id, part, toks, unnest(generate_series(1, len(toks))) AS i FROM (
    SELECT review_id, part, regexp_extract_all(regexp_replace(t, '([a-z])n''t', '\\1 n''t', 'g'), 'n''t|\\p{{L}}+') AS toks FROM ({texts})))
"""


def sign_sql(tokens: str) -> str:
    return f"""
SELECT s.review_id, s.part, s.pos, CASE WHEN any_value(n.pos) IS NULL THEN any_value(s.v) ELSE -any_value(s.v) END AS sgn
FROM (SELECT *, CASE WHEN list_contains({sql_list(lx.POSITIVE_WORDS)}, tok) THEN 1 ELSE -1 END AS v FROM {tokens}
      WHERE list_contains({sql_list(lx.POSITIVE_WORDS + lx.NEGATIVE_WORDS)}, tok)) s
LEFT JOIN (SELECT * FROM {tokens} WHERE list_contains({sql_list(lx.NEGATIONS)}, tok)) n
  ON n.review_id = s.review_id AND n.part = s.part AND n.pos BETWEEN s.pos - 3 AND s.pos - 1
GROUP BY 1, 2, 3
"""


clause_ctes("s", "lower_s")
clause_ctes("i", "lower_i")
cte("lower_r", 'SELECT *, lower("reviewText") AS lc FROM reviews_v')
clause_ctes("r", "lower_r")
for _s in "si":
    cte(f"analysed_{_s}", f"""
SELECT l.*, p.pos, p.neg, p.neu, p.men, p.has_conflict, p.dominant_aspect, p.priority_aspects, p.pattern, p.aspect_overall,
  coalesce((sentiment IN ('positive', 'amazing') AND len(neg) > 0) OR (sentiment IN ('negative', 'terrible') AND len(pos) > 0), false) AS mismatch
FROM label_{_s} l LEFT JOIN pattern_{_s} p USING (review_id)""")


def fill(template: str, value: str) -> str:
    a, b = template.split("{}")
    return f"{quote(a)} || {value} || {quote(b)}"


def listed(items: str) -> str:
    return (f"CASE WHEN len({items}) <= 1 THEN array_to_string({items}, '') ELSE "
            f"array_to_string({items}[1:len({items}) - 1], ', ') || ' and ' || {items}[-1] END")


BAD = "sentiment IN ('terrible', 'negative')"
ASPECT_REPLY = f"""concat_ws(' ',
  CASE WHEN {BAD} OR len(neg) >= 2 THEN {quote(BOOK.opening_bad)} WHEN sentiment IN ('amazing', 'positive') THEN {quote(BOOK.opening_good)}
       ELSE {quote(BOOK.opening_plain)} END,
  CASE WHEN len(neg) = 1 THEN {fill(BOOK.one_negative, '(' + listed('neg') + ')')} WHEN len(neg) > 1 THEN {fill(BOOK.many_negatives, '(' + listed('neg') + ')')} END,
  CASE WHEN len(pos) > 0 AND (len(neg) > 0 OR {BAD}) THEN CASE WHEN len(pos) = 1 THEN {fill(BOOK.one_positive, 'pos[1]')}
       ELSE {fill(BOOK.many_positives, "array_to_string(pos[1:2], ' and ')")} END END,
  CASE WHEN {BAD} OR len(neg) >= 2 THEN {quote(BOOK.closing_bad)} WHEN len(neg) > 0 THEN {quote(BOOK.closing_some)} ELSE {quote(BOOK.closing_good)} END)"""


def critical_reply(label: str) -> str:
    def note(c: str, s: str) -> str:
        return f"CASE WHEN contains('|' || categories || '|', '|{c}|') THEN {quote(s)} END"

    return f"""concat_ws(' ', CASE WHEN {label} = 'terrible' THEN {quote(BOOK.critical_terrible)} ELSE {quote(BOOK.critical_other)} END,
  {note('health_violation', BOOK.critical_health)}, {note('safety', BOOK.critical_safety)},
  {note('discrimination', BOOK.critical_discrimination)}, {quote(BOOK.critical_contact)})"""


def template(label: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in BOOK.templates.items())
    return f"CASE {label} {whens} ELSE {quote(BOOK.templates['neutral'])} END"


for _s in "si":
    cte(f"reply_{_s}", f"""
SELECT *, CASE WHEN "reviewText" IS NULL THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN n_issues > 0 THEN 'critical' WHEN coalesce(len(men), 0) > 0 THEN 'aspect' ELSE 'template' END AS route,
  CASE WHEN "reviewText" IS NULL THEN NULL WHEN n_issues > 0 THEN {critical_reply('sentiment')}
       WHEN len(men) > 0 THEN {ASPECT_REPLY} ELSE {template('sentiment')} END AS generated_response
FROM analysed_{_s}""")

TONE = "CASE WHEN len(pos) > len(neg) THEN 'mostly_positive' WHEN len(neg) > len(pos) THEN 'mostly_negative' ELSE 'mixed' END"


def pool(side: str, items: str, prime: int) -> str:
    return ", ".join(
        f"CASE WHEN list_contains({items}, '{a}') THEN {pick(BOOK.pool[a, side], f'review_id * {prime} + {i}')} END"
        for i, a in enumerate(lx.ASPECTS)
    )


cte("tone_s", f"""
SELECT review_id, tone, concat_ws(' ', CASE tone {' '.join(f"WHEN '{t}' THEN {quote(s)}" for t, s in BOOK.tone_openings.items())} END,
  {pool('positive', 'pos[1:2]', 7)}, {pool('negative', 'neg', 11)},
  CASE tone {' '.join(f"WHEN '{t}' THEN {pick(c, 'review_id * 13')}" for t, c in BOOK.closings.items())} END) AS reply
FROM (SELECT *, {TONE} AS tone FROM pattern_s)""")

# --- reply quality: pairs(review_id, "reviewText", generated_response, sentiment) -> scores

cte("pair_v", f"""
SELECT review_id, "reviewText", generated_response, sentiment FROM reply_i
UNION ALL
SELECT 3000000000 + u.conv_id * 1000 + u.turn, u.text, a.text, {pick(lx.LABELS_AMAZING, 'u.conv_id')}
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
cte("pair_trad", """SELECT review_id, "reviewText", generated_response, sentiment FROM reply_s""")
cte("pair_tone", """SELECT review_id, "reviewText", t.reply AS generated_response, sentiment FROM reply_s JOIN tone_s t USING (review_id)""")


def quality_ctes(suffix: str, source: str) -> None:
    words = "list_distinct(list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')))"
    cte(f"qtok_{suffix}", token_sql(f"SELECT review_id, 0 AS part, lower(generated_response) AS t FROM {source}"))
    cte(f"qsign_{suffix}", sign_sql(f"qtok_{suffix}"))
    cte(f"qbase_{suffix}", f"""
SELECT q.*, lower(generated_response) AS rlc, coalesce(list_contains({POS}, sentiment), false) AS is_pos,
  coalesce(list_contains({NEG}, sentiment), false) AS is_neg,
  {words.format('lower(generated_response)')} AS rw, {words.format("lower(coalesce(" + chr(34) + "reviewText" + chr(34) + ", ''))")} AS vw,
  len(list_filter(regexp_split_to_array(generated_response, '{SPACE}+'), lambda w: w <> '')) AS nw,
  length(generated_response) - length(replace(generated_response, '!', '')) AS marks,
  coalesce(h.harsh, false) AS harsh
FROM {source} q LEFT JOIN (SELECT review_id, sum(sgn)::DOUBLE / count(*) < -0.5::DOUBLE AS harsh FROM qsign_{suffix} GROUP BY 1) h USING (review_id)""")
    w = {k: " + ".join(f"{d}_score * {x}::DOUBLE" for d, x in zip(lx.DIMENSIONS, v)) for k, v in lx.QUALITY_WEIGHTS.items()}
    grades = " ".join(f"WHEN quality_raw >= {v} THEN '{g}'" for g, v in lx.GRADES)
    levels = ", ".join(
        f"CASE WHEN {d}_raw >= {hi} THEN 'high' WHEN {d}_raw >= {lo} THEN 'medium' WHEN {d}_raw IS NOT NULL THEN 'low' END AS {d}_level"
        for d, hi, lo in ((d, 8, 6) if d == "professionalism" else (d, 7, 4) for d in lx.DIMENSIONS)
    )
    cte(f"quality_{suffix}", f"""
SELECT *, {rounded('quality_raw', 2)} AS response_quality_score, CASE {grades} ELSE 'F' END AS response_grade, {levels}
FROM (SELECT *, coalesce(CASE WHEN is_neg THEN {w['negative']} WHEN is_pos THEN {w['positive']} ELSE {w['neutral']} END, 0) AS quality_raw
FROM (SELECT *, {', '.join(rounded(f'{d}_raw', 1) + f' AS {d}_score' for d in lx.DIMENSIONS)} FROM (
SELECT *, CASE WHEN ok THEN least(10.0::DOUBLE, e) END AS empathy_raw, CASE WHEN ok THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, s)) END AS specificity_raw,
  CASE WHEN ok THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, a)) END AS actionability_raw, CASE WHEN ok THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, pr)) END AS professionalism_raw
FROM (SELECT *, generated_response IS NOT NULL AND generated_response <> '' AS ok,
  {count_hits('rlc', lx.EMPATHY_HIGH)} * 3.0::DOUBLE + {count_hits('rlc', lx.EMPATHY_MEDIUM)} * 1.5::DOUBLE
    + len(list_filter(regexp_extract_all(rlc, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('we', 'our', 'us'))) * 0.5::DOUBLE
    + CASE WHEN marks IN (1, 2) THEN 1 WHEN marks > 3 THEN -1 ELSE 0 END AS e,
  CASE WHEN is_pos THEN 5.0::DOUBLE + CASE WHEN {some('rlc', lx.APPRECIATION_WORDS)} THEN 3 ELSE 0 END
         + CASE WHEN nw < 15 THEN -1.0 WHEN nw > 60 THEN -0.5 ELSE 1.0 END::DOUBLE
       ELSE 5.0::DOUBLE + ({count_hits('rlc', lx.GENERIC_PHRASES)} * -1.5::DOUBLE + {count_hits('rlc', lx.SPECIFIC_TERMS)} * 2.0::DOUBLE
         + len(list_intersect(vw, rw))::DOUBLE / greatest(len(vw), 1) * 4.0::DOUBLE)
         + CASE WHEN nw < 25 THEN -2.0 WHEN nw > 100 THEN -1.0 ELSE 1.0 END::DOUBLE END AS s,
  {count_hits('rlc', lx.ACTION_WORDS)} * 2.0::DOUBLE + CASE WHEN {some('rlc', lx.CONTACT_PHRASES)} THEN 3 ELSE 0 END
    + CASE WHEN is_neg THEN CASE WHEN {some('rlc', lx.RESOLUTION_PHRASES)} THEN 3 ELSE -2 END ELSE 0 END
    + CASE WHEN is_pos AND {some('rlc', lx.RETURN_PHRASES)} THEN 2 ELSE 0 END AS a,
  10.0::DOUBLE - CASE WHEN harsh THEN 2 ELSE 0 END - {count_hits('rlc', lx.CASUAL_TERMS)} * 1.5::DOUBLE
    - CASE WHEN NOT (left(generated_response, 1) = upper(left(generated_response, 1)) AND left(generated_response, 1) <> lower(left(generated_response, 1))) THEN 1 ELSE 0 END
    - CASE WHEN right(generated_response, 1) NOT IN ('.', '!', '?') THEN 0.5::DOUBLE ELSE 0 END
    - CASE WHEN contains(generated_response, '!!') THEN 2 ELSE 0 END
    - CASE WHEN len(list_filter(regexp_split_to_array(generated_response, '{SPACE}+'), lambda w: length(w) > 3 AND w = upper(w) AND w <> lower(w))) > 0 THEN 2 ELSE 0 END
    - CASE WHEN nw < 10 THEN 2 ELSE 0 END AS pr
FROM qbase_{suffix}))))""")


for _name in ("v", "trad", "tone"):
    quality_ctes(_name, f"pair_{_name}")


def extreme(kind: str, order: str) -> str:
    return f"""(SELECT '{kind}' AS kind, review_id, response_quality_score AS score, response_grade AS grade,
      left(coalesce(generated_response, ''), 100) AS response, left(coalesce("reviewText", ''), 100) AS review
      FROM quality_v ORDER BY response_quality_score {order}, review_id {'ASC' if order == 'DESC' else 'DESC'} LIMIT 1)"""


_context = """concat_ws(' | ', 'Place: ' || "placeName", 'Location: ' || "placeAddress", 'Platform: ' || provider,
  'Rating: ' || "reviewRating", 'Sentiment: ' || corrected_sentiment)"""
_how = "CASE corrected_sentiment " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in BOOK.instructions.items()) + " END"
_wraps = {
    name: "CASE corrected_sentiment " + " ".join(f"WHEN '{k}' THEN {pick(v, f'review_id * {prime}')}" for k, v in sets.items())
    + f" ELSE {pick(sets['neutral'], f'review_id * {prime}')} END"
    for name, sets, prime in (("intro", BOOK.wrap_intro, 5), ("closing", BOOK.wrap_closing, 17))
}
_tidy = "upper(left(t, 1)) || substr(t, 2) || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE '.' END"
_dims = ", ".join(f"{d}_score" for d in lx.DIMENSIONS)
_means = "\nUNION ALL ".join(f"SELECT '{d}' AS dimension, round(avg({d}_score), 2) AS current_score FROM quality_v" for d in lx.DIMENSIONS)
_lowest = "\nUNION ALL ".join(f"SELECT review_id, {i} AS o, '{d}' AS d, {d}_score AS s FROM quality_v" for i, d in enumerate(lx.DIMENSIONS))


def arr(column: str) -> str:
    return f"array_to_string({column}, '|')"


cte("wide_i", "SELECT review_id, " + ", ".join(
    f"max({part}) FILTER (aspect = '{a}') AS {a}_{part}" for a in lx.ASPECTS for part in ("sentiment", "score")) + " FROM aspect_i GROUP BY 1")
cte("found_i", "SELECT review_id, string_agg(category || ': ' || array_to_string(kw, ', '), '; ' ORDER BY o) AS found FROM issue_i GROUP BY 1")
cte("record_i", f"""
SELECT r.review_id, "placeName", "placeAddress", provider, "authorName", "reviewRating", "reviewDate", status,
  CASE WHEN status <> 'success' THEN 'no review text' END AS error,
  CASE WHEN status = 'success' THEN sentiment END AS sentiment, CASE WHEN status = 'success' THEN confidence END AS confidence,
  CASE WHEN status = 'success' THEN n_issues > 0 AND corrected_sentiment <> 'terrible' END AS overridden_by_critical_issue,
  CASE WHEN status = 'success' THEN coalesce(found, '') END AS matched_keywords, {", ".join(f"w.{a}_{part}" for a in lx.ASPECTS for part in ("sentiment", "score"))}
FROM reply_i r LEFT JOIN wide_i w ON r.review_id = w.review_id LEFT JOIN found_i f ON r.review_id = f.review_id""")
_pairs = [(f"{a}_sentiment", f"expected_{a}") for a in ("food", "service")]
_seen = [f"({s} <> 'not_mentioned')::INT" for s, _ in _pairs]
_right = [f"({s} <> 'not_mentioned' AND {s} = coalesce({e}, {s}))::INT" for s, e in _pairs]
_missed = ", ".join(f"CASE WHEN {s} <> 'not_mentioned' AND {s} <> {e} THEN '{e.removeprefix('expected_')}' END" for s, e in _pairs)
cte("expected_i", f"""
SELECT review_id, sentiment, expected_overall, sentiment = expected_overall AS passed, {" + ".join(_seen)} AS aspects_seen,
  {" + ".join(_right)} AS aspects_right, concat_ws('|', {_missed}) AS aspects_failed
FROM (SELECT *, ({sql_list(lx.LABELS_AMAZING)})["reviewRating"] AS expected_overall,
        CASE WHEN "reviewRating" >= 4 THEN 'positive' WHEN "reviewRating" <= 2 THEN 'negative' END AS expected_food, expected_food AS expected_service
      FROM record_i WHERE status = 'success')""")
_asked = f"""concat_ws(chr(10), 'Draft our answer to the guest below.',
        'Context: ' || {_context}, 'Reviewer: ' || "authorName", 'Review: "' || coalesce("reviewText", '') || '"',
        'Task: ' || {_how}, 'Answer:')"""
_shown = ", ".join(quote(f'Example {n}\nReview: "{r}"\nSentiment: {m}\nAnswer: {a}') for n, (r, m, a) in enumerate(EXAMPLES, 1))


SQL = {
    "prompt_forms": f"""SELECT review_id, concat_ws(chr(10) || chr(10), {_shown}, {_asked}) AS with_examples,
        '[INST] ' || concat_ws(chr(10), 'You answer guests of ' || coalesce("placeName", 'the house') || '.', 'Context: ' || {_context}, 'Guest: ' || "authorName",
          'Review: "' || coalesce("reviewText", '') || '"', 'Two or three sentences; ' || {_how} || '.') || ' [/INST]' AS tagged,
        concat_ws(chr(10), {_context}, 'Guest: ' || "authorName", 'Review: ' || coalesce("reviewText", ''), 'Our answer:') AS plain FROM label_i""",
    "reply_tone_wide": "SELECT * FROM tone_s",
    "triage_record": "SELECT * FROM record_i",
    "expectation_check": "SELECT * FROM expected_i",
    "expectation_summary": """SELECT count(*) AS reviews, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
        round(coalesce(avg(CASE WHEN passed THEN 100.0::DOUBLE ELSE 0 END), 0), 1) AS success_rate FROM expected_i""",
    "scorer_plugin": """SELECT review_id, CASE WHEN s > 0.1::DOUBLE THEN 'positive' WHEN s < -0.1::DOUBLE THEN 'negative' ELSE 'neutral' END AS label,
        least(t / 5.0::DOUBLE, 1.0::DOUBLE) AS confidence,
        '{"positive":' || ((1 + s) / 2)::VARCHAR || ',"negative":' || ((1 - s) / 2)::VARCHAR || '}' AS probabilities
        FROM (SELECT review_id, sum(pw + nw) AS t, coalesce((sum(pw) - sum(nw))::DOUBLE / nullif(sum(pw + nw), 0), 0) AS s FROM score_r GROUP BY 1)""",
    "critical_keywords": "SELECT review_id, category, array_to_string(kw, '|') AS matched_keywords, severity, action FROM issue_s",
    "critical_severity": "SELECT review_id, severity FROM label_s",
    "critical_actions": "SELECT review_id, coalesce(actions, '') AS actions_required FROM label_s",
    "critical_flags": """SELECT review_id, n_issues > 0 AS has_critical_issue, severity = 'critical' AS should_escalate,
        n_issues > 0 AS should_override_sentiment FROM label_s""",
    "escalations": "SELECT review_id, string_agg(CASE category " + " ".join(
        f"WHEN '{c}' THEN {quote(n)}" for c, n in ESCALATION_NOTES.items()) + " END, ' | ' ORDER BY o) AS message FROM issue_s GROUP BY 1",
    "sarcasm": "SELECT review_id, sarcastic AS is_sarcastic, sarcasm_confidence AS confidence FROM label_s",
    "sarcasm_corrected": """SELECT review_id, original_sentiment, corrected_sentiment, sarcastic AS sarcasm_detected, sarcasm_confidence,
        original_sentiment <> corrected_sentiment AS was_corrected FROM label_s""",
    "final_sentiment": "SELECT review_id, original_sentiment, sentiment FROM label_s",
    "clauses": "SELECT review_id, clause_no, clause FROM clause_s",
    "aspect_mentions": "SELECT review_id, clause_no, aspect FROM mention_s",
    "clause_sentiment": """SELECT review_id, clause_no, pw AS positive_words, nw AS negative_words, sentiment, score, confidence FROM score_s""",
    "scorer_signed": """SELECT review_id, CASE WHEN abs(x) < 0.4::DOUBLE THEN 'neutral' WHEN p >= 3 THEN 'positive' ELSE 'negative' END AS sentiment,
        round(CASE WHEN p >= 3 THEN x ELSE -x END, 3) AS score, round(x, 3) AS confidence
        FROM (SELECT review_id, p, confidence - 0.15::DOUBLE AS x FROM scored_v)""",
    "aspect_sentiment": "SELECT review_id, aspect, sentiment, score, confidence, num_mentions FROM aspect_s",
    "aspects_mentioned": f"SELECT review_id, {arr('men')} AS aspects_mentioned, has_conflict AS has_mixed_sentiment FROM pattern_s",
    "dominant_aspect": "SELECT review_id, dominant_aspect FROM pattern_s",
    "priority_aspects": f"SELECT review_id, {arr('priority_aspects')} AS priority_aspects FROM pattern_s",
    "aspect_pattern": f"""SELECT review_id, pattern, {arr('pos')} AS positive_aspects, {arr('neg')} AS negative_aspects,
        {arr('neu')} AS neutral_aspects FROM pattern_s""",
    "aspect_mismatch": "SELECT review_id, sentiment, mismatch FROM analysed_s",
    "aspect_overall": "SELECT review_id, aspect_overall AS dominant_sentiment FROM pattern_s",
    "response_strategy": """SELECT review_id, tone, pattern, has_conflict AS has_mixed,
        CASE WHEN tone = 'apologetic_urgent' THEN 'urgent' ELSE 'normal' END AS priority,
        array_to_string(list_concat(list_transform(neg, lambda x: x || ':apologize:high'),
          CASE WHEN starts_with(tone, 'apologetic') THEN list_transform(pos[1:2], lambda x: x || ':acknowledge:medium') ELSE []::VARCHAR[] END), '|') AS address_aspects
        FROM (SELECT *, CASE WHEN sentiment IN ('terrible', 'negative') OR len(neg) >= 2 THEN 'apologetic_urgent'
          WHEN len(neg) = 1 THEN 'apologetic_standard' WHEN sentiment = 'neutral' THEN 'appreciative_improving' ELSE 'enthusiastic' END AS tone FROM analysed_s)""",
    "aspect_report": """SELECT aspect, round(avg(CASE WHEN num_mentions > 0 THEN 100.0::DOUBLE ELSE 0 END), 2) AS mention_rate,
        count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
        count(*) FILTER (sentiment = 'neutral') AS neutral_count, round(avg(score) FILTER (num_mentions > 0), 6) AS avg_score
        FROM aspect_s GROUP BY 1""",
    "aspect_agreement": """SELECT count(*) AS reviews, round(avg(CASE WHEN same THEN 100.0::DOUBLE ELSE 0 END), 2) AS agreement_rate,
        count(*) FILTER (NOT same) AS disagreements,
        array_to_string((list(review_id ORDER BY review_id) FILTER (NOT same))[1:3], ',') AS examples
        FROM (SELECT review_id, CASE WHEN "reviewRating" >= 4 THEN 'positive' WHEN "reviewRating" <= 2 THEN 'negative' ELSE 'neutral' END = aspect_overall AS same
              FROM pattern_s JOIN scored_v USING (review_id) WHERE len(men) > 0)""",
    "triage": "SELECT review_id, status, " + ", ".join(
        f"CASE WHEN status = 'success' THEN {e} END AS {n}" for n, e in {
            "categories": "categories", "aspects_mentioned": arr("men"), "positive_aspects": arr("pos"), "negative_aspects": arr("neg"),
            "priority_aspects": arr("priority_aspects"), "severity": "severity", "should_escalate": "severity = 'critical'",
            "original_sentiment": "original_sentiment", "sarcasm_detected": "sarcastic", "sarcasm_confidence": "sarcasm_confidence",
            "corrected_sentiment": "corrected_sentiment", "sentiment": "sentiment", "confidence": "confidence", "has_conflict": "has_conflict",
            "dominant_aspect": "dominant_aspect", "pattern": "pattern", "mismatch": "mismatch", "aspect_overall": "aspect_overall",
            "generated_response": "generated_response"}.items()) + " FROM reply_i",
    "batch_score": """SELECT review_id, CASE WHEN status = 'success' THEN sentiment ELSE 'error' END AS sentiment,
        CASE WHEN status = 'success' THEN confidence ELSE 0 END AS confidence, coalesce(generated_response, '') AS generated_response FROM reply_i""",
    "reply_aspect": f"SELECT review_id, {ASPECT_REPLY} AS reply FROM analysed_s",
    "reply_critical": f"""SELECT review_id, {critical_reply('sentiment')} AS reply, {critical_reply('corrected_sentiment')} AS reply_before_override
        FROM label_s WHERE n_issues > 0""",
    "reply_template": f"""SELECT review_id, label, {template('label')} AS reply FROM (
        SELECT review_id, CASE WHEN review_id % 13 = 0 THEN 'unheard of' ELSE corrected_sentiment END AS label FROM label_s)""",
    "reply_router": "SELECT review_id, route, generated_response FROM reply_i",
    "reply_tone": "SELECT * FROM tone_s",
    "prompt_batch": f"SELECT review_id, {_context} AS context, {_asked} AS prompt FROM label_i",
    "reply_tidy": f"""SELECT review_id, CASE WHEN len(string_split(w, '. ')) > 4 THEN array_to_string(string_split(w, '. ')[1:4], '. ') || '.' ELSE w END AS tidy
        FROM (SELECT review_id, CASE WHEN t = '' THEN '' ELSE {_tidy} END AS w FROM (SELECT review_id, {squeeze('"reviewText"')} AS t FROM reviews_v))""",
    "reply_wrap": f"""SELECT review_id, CASE WHEN (review_id * 31) % 10 >= 3 THEN {_wraps['intro']} || ' ' || t || ' ' || {_wraps['closing']} ELSE t END AS reply
        FROM (SELECT *, {template('corrected_sentiment')} AS t FROM label_s)""",
    **{f"quality_{d}": f"SELECT review_id, {d}_score FROM quality_v" for d in lx.DIMENSIONS},
    "quality_levels": "SELECT review_id, " + ", ".join(f"{d}_level" for d in lx.DIMENSIONS) + " FROM quality_v",
    "quality_total": "SELECT review_id, response_quality_score FROM quality_v",
    "quality_grade": "SELECT review_id, response_grade FROM quality_v",
    "quality_batch": f"SELECT review_id, response_quality_score, response_grade, {_dims} FROM quality_v",
    "quality_report": "SELECT count(*) AS total_responses, round(avg(response_quality_score), 2) AS average_quality_score, "
        + ", ".join(f"round(avg({d}_score), 2) AS {d}" for d in lx.DIMENSIONS) + " FROM quality_v",
    "grade_distribution": f"""SELECT g AS grade, count(response_grade) AS count,
        round(count(response_grade) * 100.0::DOUBLE / (SELECT count(*) FROM quality_v), 2) AS percentage
        FROM (SELECT unnest({sql_list(lx.GRADE_ORDER)}) AS g) LEFT JOIN quality_v ON g = response_grade GROUP BY 1""",
    "quality_extremes": extreme("best", "DESC") + " UNION ALL " + extreme("worst", "ASC"),
    "improvement_areas": f"SELECT dimension, current_score, round(8 - current_score, 2) AS gap FROM ({_means}) WHERE current_score < 6",
    "quality_by_label": "SELECT sentiment, round(avg(response_quality_score), 6) AS avg_quality FROM quality_v GROUP BY 1",
    "reply_ab": """SELECT round(avg(a), 6) AS traditional_average, round(avg(b), 6) AS aspect_average, round(avg(b - a), 6) AS average_improvement,
        count(*) FILTER (b - a > 0) AS improved, round(avg(CASE WHEN b - a > 0 THEN 100.0::DOUBLE ELSE 0 END), 2) AS improved_pct,
        array_to_string((list(review_id ORDER BY round(b - a, 2) DESC, review_id))[1:3], ',') AS top_ids
        FROM (SELECT t.review_id, t.response_quality_score AS a, s.response_quality_score AS b FROM quality_trad t JOIN quality_tone s USING (review_id))""",
    "weakest_dimension": f"""SELECT review_id, first(d ORDER BY s, o) FILTER (s IS NOT NULL) AS weakest, min(s) AS score FROM ({_lowest}) GROUP BY 1""",
    "batch_summary": f"""SELECT l AS label, (SELECT count(*) FROM reply_i) AS total, n AS successful, (SELECT count(*) FROM reply_i) - n AS failed,
        count(review_id) AS count, round(count(review_id) * 100.0::DOUBLE / n, 2) AS percentage
        FROM (SELECT unnest({sql_list(lx.LABELS_AMAZING)}) AS l, (SELECT count(*) FROM reply_i WHERE status = 'success') AS n)
        LEFT JOIN (SELECT * FROM reply_i WHERE status = 'success') ON l = sentiment GROUP BY l, n""",
    "running_confidence": """SELECT review_id, "placeName", count(*) OVER w AS total_processed, count("reviewText") OVER w AS successful,
        count(*) OVER w - count("reviewText") OVER w AS failed,
        coalesce(sum(CASE WHEN "reviewText" IS NOT NULL THEN confidence::DECIMAL(20, 12) END) OVER w, 0)::DOUBLE / nullif(count("reviewText") OVER w, 0)::DOUBLE AS avg_confidence
        FROM inbox_v WINDOW w AS (PARTITION BY "placeName" ORDER BY "reviewDate", review_id ROWS UNBOUNDED PRECEDING)""",
    "recent_50": "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "label_counters": """SELECT sentiment, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
        FROM label_i WHERE "reviewText" IS NOT NULL GROUP BY 1""",
    "head_n": "SELECT * FROM reviews_v ORDER BY review_id LIMIT 100",
}


def oracle() -> dict[str, str]:
    return {key: with_ctes(sql) for key, sql in SQL.items()}
