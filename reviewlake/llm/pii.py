"""Information-theoretic sanitisation of personal data, in built-in expressions only.

1. *Entities.* E-mail and network addresses, card and phone numbers are found by pattern and checked (parts up to 255, Luhn
   sum, digit counts). Their values are the entities to protect.
2. *Co-occurrence.* A term is a run of three or more letters. It occurs with an entity in a text where it stands within
   `reach` code points of a mention. Texts are counted, each distinct text once, so copies prove nothing.
3. *Disclosure.* A term's pointwise mutual information with an entity, as a share of what the entity itself tells:
   log(N n_et / (n_e n_t)) / log(N / n_e). It is 1 where the term stands only in texts that name the entity. Terms that
   reach `threshold` for any entity, in at least `support` texts, disclose it; they are found in every text.
4. *Sanitising.* Base spans give way to the name of their kind. A disclosing term is generalised to its first letters if
   the class of all terms that begin so stays under the threshold for every entity, and removed otherwise.

The spans of a text come from its row alone: a pattern's matches and the pieces between them give positions by running
sums in blocks, so many matches in one text cost no square. Patterns cannot backtrack over long runs. Corpus counts shuffle
digests and terms, never texts: only terms that can still reach the threshold are counted in the corpus. The
disclosing terms of a text are joined to it by digest; that table is written first, so that the planner knows its size
and broadcasts it only under its own limit, and splits hot digests beyond.

Defined results: a null text counts as empty and has no spans; the empty table gives an empty result; equal texts have
equal results; several kinds may overlap, and overlapping spans are replaced as one, by the first one's name. Other columns
pass through; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

SUPPORT = 3
THRESHOLD = 0.9
REACH = 100
LETTERS = 3
WORD = r"\p{L}{3,}+"
RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "sanitised")
#: Possessive, and tied to the start of a run, so that no run is read twice; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have such a span at all.
HINTS = {"email": "@", "ip": r"\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it several times."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, step: int = 64) -> Column:
    """Sums of all numbers before each one, in blocks of `step`."""
    add = lambda a, b: a + b
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), add)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda c: F.slice(xs, c * step + 1, F.lit(step)))
    before = lambda blocks: F.aggregate(
        blocks, F.array(F.lit(0).cast("long")), lambda got, block: F.concat(got, F.array(F.element_at(got, -1) + total(block)))
    )
    inside = lambda blocks, sums: F.flatten(
        F.transform(blocks, lambda block, c: F.transform(block, lambda _, i: sums[c] + total(F.slice(block, F.lit(1), i))))
    )
    summed = let(numbers, lambda xs: let(cut(xs), lambda blocks: let(before(blocks), lambda sums: inside(blocks, sums))))
    return F.when(F.size(numbers) == 0, F.array().cast("array<bigint>")).otherwise(summed)


def _words_beside(left: Column, right: Column, reach: int) -> Column:
    """Distinct terms within reach of a match between two pieces; letters that touch it or are cut by the border are none."""
    ending, leading = r"\p{L}+$", r"^\p{L}+"
    near_left = F.regexp_replace(F.when(F.length(left) > reach, F.regexp_replace(F.right(left, F.lit(reach)), leading, "")).otherwise(left), ending, "")
    near_right = F.regexp_replace(F.when(F.length(right) > reach, F.regexp_replace(F.left(right, F.lit(reach)), ending, "")).otherwise(right), leading, "")
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", near_left, near_right), F.lit(WORD), F.lit(0)))


def matches(text: Column, pattern: Column, reach: int = 0) -> Column:
    """array<struct<start, stop, value[, near]>> of all matches, in code points."""

    def spans(both: Column) -> Column:
        values, gaps = both["values"], both["gaps"]
        lengths = F.transform(values, lambda v, i: (F.length(gaps[i]) + F.length(v)).cast("long"))
        near = (lambda i: [_words_beside(gaps[i], gaps[i + 1], reach).alias("near")]) if reach else (lambda i: [])
        return let(running(lengths), lambda before: F.transform(values, lambda v, i: F.struct(
            (before[i] + F.length(gaps[i])).alias("start"),
            (before[i] + F.length(gaps[i]) + F.length(v)).alias("stop"),
            v.alias("value"), *near(i),
        )))

    return let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps")), spans)


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, reach: int = 0) -> Column:
    hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    found = F.filter(matches(text, F.lit(PATTERNS[kind]), reach), lambda s: _holds(kind, s["value"]))
    shape = "array<struct<start:bigint,stop:bigint,value:string" + (",near:array<string>>>" if reach else ">>")
    return F.when(hint, found.cast(shape)).otherwise(F.array().cast(shape))


def entity(kind: str, value: Column) -> Column:
    """One name for each way of writing a value."""
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), plain)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def mentions(texts: DataFrame, reach: int = REACH) -> DataFrame:
    """Distinct (entity, term, digest); the term is null in one row for each entity of a text."""

    def marks(kind: str) -> Column:
        return F.transform(base_spans(F.col("text"), kind, reach), lambda s: F.struct(entity(kind, s["value"]).alias("entity"), s["near"].alias("near")))

    likely = F.col("text").rlike(r"[0-9@]")
    named = texts.filter(likely).withColumn("digest", digest(F.col("text")))  # below the explode, once for each text
    each = named.select("digest", F.explode(F.concat(*map(marks, PATTERNS))).alias("m"))
    term = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("m.near")))
    return each.select("digest", F.col("m.entity").alias("entity"), term.alias("term")).distinct()


def terms_of(texts: DataFrame, name: Column, wanted: DataFrame) -> DataFrame:
    """Distinct (digest, name) of the words whose name is wanted; `wanted` has one row for each name."""
    named = texts.withColumn("digest", digest(F.col("text")))
    words = named.select("digest", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term"))
    return words.select("digest", name.alias("name")).join(wanted, "name").distinct()


def candidates(near: DataFrame, entities: DataFrame, texts: int, support: int, threshold: float) -> DataFrame:
    """(entity, name, n_et, n_e) that can still reach the threshold; near: distinct (entity, name, digest).

    To reach it a name may stand in n_et (N / n_e)^(1 - threshold) texts at most, and it stands in no fewer than those where
    it is near any mention. So a common word is out before the corpus is counted, and no name that could reach it is.
    """
    met = near.select("name", "digest").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_m"))
    seen = near.groupBy("entity", "name").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    known = seen.join(entities, "entity").filter(F.col("n_e") < texts).join(met, "name")
    most = F.col("n_et") * F.pow(F.lit(float(texts)) / F.col("n_e"), F.lit(1 - threshold)) * (1 + 1e-9)
    return known.filter(F.col("n_m") <= most).select("entity", "name", "n_et", "n_e")


def _reaching(seen: DataFrame, held: DataFrame, texts: int, threshold: float) -> DataFrame:
    """(name, disclosure) of names that reach the threshold for some entity; held: (digest, name)."""
    spread = held.groupBy("name").agg(F.count(F.lit(1)).alias("n_t"))
    told = F.log(F.lit(float(texts)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(texts)) / F.col("n_e"))
    return seen.join(spread, "name").groupBy("name").agg(F.max(told).alias("disclosure")).filter(F.col("disclosure") >= threshold)


def disclosing_terms(texts: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure, general) of the disclosing terms, general null where the class discloses too, and (digest, term)."""
    total = texts.select(digest(F.col("text")).alias("digest")).distinct().count()
    met = C.settled(mentions(texts, reach), "mentions")
    entities = C.settled(met.filter(F.col("term").isNull()).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    near = met.filter(F.col("term").isNotNull())
    pairs = C.settled(candidates(near.withColumnRenamed("term", "name"), entities, total, support, threshold), "pairs")
    held = C.settled(terms_of(texts, F.col("term"), C.settled(pairs.select("name").distinct(), "wanted")), "held")
    strong = C.settled(_reaching(pairs, held, total, threshold), "strong")
    of = F.left("term", F.lit(LETTERS))
    classes = C.settled(strong.select(F.left("name", F.lit(LETTERS)).alias("name")).distinct(), "classes")
    wide = near.select("entity", of.alias("name"), "digest").join(classes, "name").distinct()
    open_classes = C.settled(candidates(wide, entities, total, support, threshold), "classes")
    counted = terms_of(texts, of, C.settled(open_classes.select("name").distinct(), "wanted"))
    shut = _reaching(open_classes, counted, total, threshold).select(F.col("name").alias("class"), F.lit(True).alias("shut"))
    terms = strong.withColumn("class", F.left("name", F.lit(LETTERS))).join(shut, "class", "left")
    terms = terms.select(F.col("name").alias("term"), "disclosure", F.when(F.col("shut").isNull(), F.concat("class", F.lit("*"))).alias("general"))
    return C.settled(terms, "terms"), held.select("digest", F.col("name").alias("term"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first one's replacement; spans are in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(got: Column, s: Column) -> Column:
        more = F.concat(got["out"], F.substring(text, got["at"].cast("int") + 1, (s["start"] - got["at"]).cast("int")), s["put"])
        return F.struct(F.greatest(got["at"], s["stop"]).alias("at"), F.when(s["start"] >= got["at"], more).otherwise(got["out"]).alias("out"))

    return F.aggregate(spans, start, add, lambda got: F.concat(got["out"], F.substring(text, got["at"].cast("int") + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """All columns of `docs` with counts, base_sha256, spans (array of kind, start, stop) and the sanitised text."""
    passed = [c for c in docs.columns if c not in RESULTS or c == text]
    texts = docs.select(C.text_or_empty(text).alias("text"))
    terms, held = disclosing_terms(texts, support, threshold, reach)
    chosen = held.join(terms, "term").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("general", F.lit(""))))).alias("__terms"))
    chosen = C.settled(chosen, "chosen").withColumnRenamed("digest", "__digest")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(*[f"`{c}`" for c in passed], *[base_spans(body, k).alias(f"__{k}") for k in PATTERNS], digest(body).alias("__digest"))
    found = found.join(chosen, "__digest", "left")

    def named(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"[{kind.upper()}]").alias("put")))

    base = F.concat(*map(named, PATTERNS))
    either = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("__terms"), "|"), F.lit(r")(?!\p{L})"))
    more = F.when(F.col("__terms").isNull(), F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")).otherwise(matches(body, either))
    apart = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"]))
    hidden = F.transform(F.filter(more, apart), lambda s: F.struct(
        F.lit("term").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.element_at("__terms", s["value"]).alias("put")))
    digits = lambda spans: F.array_join(written(F.col(spans)), ",")
    every = found.withColumn("__base", base).withColumn("__all", F.concat("__base", hidden))
    ordered = F.array_sort("__all", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["stop"] > b["stop"], -1).when(a["stop"] < b["stop"], 1).otherwise(0))
    return every.select(
        *[f"`{c}`" for c in passed],
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(digits("__base"), 256).alias("base_sha256"),
        F.transform("__all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"),
        _replaced(body, ordered).alias("sanitised"),
    )


def written(spans: Column) -> Column:
    """kind:start:stop of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents`."""
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    return sanitise(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(written(F.col("spans")), ",").alias("spans"))


#: The plain patterns of the base kinds, for engines that do not backtrack.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def oracle_sql(support: int = SUPPORT, threshold: float = THRESHOLD, reach: int = REACH) -> str:
    """The same definitions over plain patterns."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    holds = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (i % 2) = 0 AND 2 * CAST(substr({digits}, -i, 1) AS INT) > 9 THEN 2 * CAST(substr({digits}, -i, 1) AS INT) - 9 "
        f"WHEN (i % 2) = 0 THEN 2 * CAST(substr({digits}, -i, 1) AS INT) ELSE CAST(substr({digits}, -i, 1) AS INT) END FOR i IN range(1, len({digits}) + 1)]) % 10 = 0",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
    }
    named = {"email": "lower(m)", "ip": "m", "card": digits, "phone": digits}
    split = lambda k, p: f"""{k}_parts AS MATERIALIZED (  -- matches with their places and the pieces beside them
            SELECT id, i, vs[i] AS m, gs[i] AS l, gs[i + 1] AS r,
                CAST(sum(len(gs[i]) + len(vs[i])) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS stop
            FROM (SELECT id, regexp_extract_all(body, '{p}') AS vs, string_split_regex(body, '{p}') AS gs FROM docs) d, range(1, len(vs) + 1) r(i))"""  # noqa: E731
    rows = " UNION ALL ".join(f"SELECT id, {n} AS o, '{k}' AS kind, stop - len(m) AS start, stop, '{k}:' || {named[k]} AS entity, l, r FROM {k}_parts WHERE {holds[k]}" for n, k in enumerate(PLAIN))
    word = r"\p{L}{3,}"
    side = lambda x, cut, touch, end: f"regexp_replace(CASE WHEN len({x}) > {reach} THEN regexp_replace({end}({x}, {reach}), '{cut}', '') ELSE {x} END, '{touch}', '')"
    beside = f"{side('l', '^\\p{L}+', '\\p{L}+$', 'right')} || ' ' || {side('r', '\\p{L}+$', '^\\p{L}+', 'left')}"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body, sha256(coalesce(text, '')) AS digest FROM documents),
        total AS MATERIALIZED (SELECT CAST(count(DISTINCT digest) AS DOUBLE) AS n FROM docs),
        {", ".join(split(k, p) for k, p in PLAIN.items())},
        base AS MATERIALIZED ({rows}),
        entities AS MATERIALIZED (SELECT entity, count(DISTINCT digest) AS n_e FROM base JOIN docs USING (id) GROUP BY entity),
        pairs AS MATERIALIZED (
            SELECT entity, term, count(DISTINCT digest) AS n_et FROM (
                SELECT entity, digest, unnest(regexp_extract_all({beside}, '{word}')) AS term FROM base JOIN docs USING (id))
            GROUP BY entity, term HAVING count(DISTINCT digest) >= {support}),
        held AS MATERIALIZED (
            SELECT DISTINCT digest, term FROM (SELECT digest, unnest(regexp_extract_all(body, '{word}')) AS term FROM docs)
            WHERE term IN (SELECT term FROM pairs)),
        strong AS MATERIALIZED (
            SELECT DISTINCT term FROM pairs JOIN entities USING (entity) JOIN (SELECT term, count(*) AS n_t FROM held GROUP BY term) USING (term), total
            WHERE n_e < n AND ln(n * n_et / (n_e * n_t)) / ln(n / n_e) >= {threshold}),
        places AS (  -- every word of the texts that hold a disclosing term
            SELECT id, ws[i] AS term, CAST(sum(len(gs[i]) + len(ws[i])) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS stop
            FROM (SELECT id, regexp_extract_all(body, '\\p{{L}}+') AS ws, string_split_regex(body, '\\p{{L}}+') AS gs FROM docs
                WHERE digest IN (SELECT digest FROM held JOIN strong USING (term))) d, range(1, len(ws) + 1) r(i)),
        every AS (
            SELECT id, o, kind, start, stop FROM base UNION ALL
            SELECT id, 4, 'term', stop - len(term), stop FROM places p WHERE term IN (SELECT term FROM strong)
                AND NOT EXISTS (SELECT 1 FROM base b WHERE b.id = p.id AND b.start < p.stop AND b.stop > p.stop - len(p.term))),
        joined AS (
            SELECT id, {", ".join(f"count(*) FILTER (o = {n}) AS n_{k}" for n, k in enumerate(PLAIN))},
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 4) AS base,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans
            FROM every GROUP BY id)
        SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in PLAIN)},
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN joined USING (id)"""
