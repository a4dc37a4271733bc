import pytest
from pyspark.sql import functions as F

from reviewlake.operators import aspects, critical, replies, reply_quality, sarcasm, triage


@pytest.mark.parametrize("text, found", [
    ("The soup came with a long hair on top, the bread was fresh", ["health_violation"]),
    ("Lovely noodles on the terrace", []),
    ("Two of us had food poisoning after the oysters", ["health_violation"]),
    ("It took half an hour, which is fine", []),
    ("We are never coming back to this street", ["extreme_negative"]),
    ("I am grateful, no bug at all", []),
    ("A celebration", ["health_violation"]),
    ("They stole my credit card and someone fell", ["safety", "theft_fraud"]),
])
def test_critical_categories(texts, text, found):
    df = triage.add_issues(texts(text))
    assert df.first().categories == found


def test_word_match_and_severity(texts):
    lc = F.lower("reviewText")
    df = texts("A celebration on a chair", "racist and a scam")
    got = df.select(critical.categories(lc, "word").alias("w"), critical.severity(critical.categories(lc)).alias("s")).collect()
    assert [r.w for r in got] == [[], ["discrimination", "theft_fraud"]]
    assert got[1].s == "critical"


@pytest.mark.parametrize("text, expected", [
    ("Oh great, the lights went out. Just wonderful.", True),
    ("The dumplings were steaming!", False),
    ("Yeah right, best view ever.", False),  # one pattern alone scores 0.4
    ("Two plates of rice!", False),
    ("Obviously the soup was cold!", True),     # 0.4 + 0.2 exceeds 0.6 in binary
])
def test_sarcasm(texts, text, expected):
    t, lc = F.col("reviewText"), F.lower("reviewText")
    assert texts(text).select(sarcasm.is_sarcastic(sarcasm.score(t, lc))).first()[0] is expected


def clauses_of(texts, text):
    return [c["clause"] for c in aspects.add_clauses(texts(text)).first().clauses]


@pytest.mark.parametrize("text, parts", [
    ("a but b but c", ["a", "b", "c"]),
    ("a But b but c", ["a", "b but c"]),
    ("a yet b but c", ["a yet b", "c"]),
    ("nothing here", ["nothing here"]),
    ("a but ", ["a", ""]),
])
def test_clause_split(texts, text, parts):
    assert clauses_of(texts, text) == parts


@pytest.mark.parametrize("text, p, n", [
    ("good", 1, 0), ("not good", 0, 1), ("not at all good", 0, 1), ("not one two three good", 1, 0),
    ("never bad", 1, 1), ("wasn't great", 0, 1), ("", 0, 0), ("bad, awful and nice", 1, 2),
])
def test_negation_window(texts, text, p, n):
    c = aspects.add_clauses(texts(text)).first().clauses[0]
    assert (c["positive_words"], c["negative_words"]) == (p, n)


def test_aspects_of_a_mixed_review(texts):
    df = aspects.add_patterns(aspects.add_aspects(aspects.add_clauses(texts(
        "Best pizza ever, but the waiter was rude", "we sat there", ""))))
    mixed, plain, empty = df.orderBy("review_id").collect()
    assert {a["aspect"]: a["sentiment"] for a in mixed.aspects if a["num_mentions"]} == {"food": "positive", "service": "negative"}
    assert (mixed.pattern, mixed.priority_aspects, mixed.aspect_overall) == ("mixed_sentiment", ["service"], "neutral")
    assert mixed.dominant_aspect == "food"
    for r in (plain, empty):
        assert r.pattern == "no_aspects_mentioned" and len(r.aspects) == 5 and r.dominant_aspect is None and r.negative_aspects == []


def test_triage_order_and_failed_row(spark):
    df = spark.createDataFrame(
        [(1, "Oh great, just wonderful, a cold soup", 5, 0.9), (2, "a hair in the soup", 5, 0.8), (3, None, 4, 0.7), (4, "fine place", 5, 0.6)],
        "review_id long, reviewText string, p int, confidence double")
    got = {r.review_id: r for r in triage.flat(triage.triage(df)).collect()}
    assert (got[1].sentiment, got[1].original_sentiment) == ("negative", "amazing")
    assert (got[2].sentiment, got[2].should_escalate) == ("terrible", True)
    assert (got[3].status, got[3].sentiment, got[3].generated_response) == ("failed", None, None)
    assert got[4].generated_response == replies.DEFAULT_BOOK.templates["amazing"]
    batch = {r.review_id: r for r in triage.batch_score(triage.triage(df)).collect()}
    assert (batch[3].sentiment, batch[3].confidence, batch[3].generated_response) == ("error", 0.0, "")


def test_text_column_fallback(spark):
    df = spark.createDataFrame([(1, None, "from text", 3, 0.5)], "review_id long, reviewText string, text string, p int, confidence double")
    assert triage.triage(df).first().status == "success"


def test_signed_score(spark):
    df = spark.createDataFrame([("POSITIVE", 0.9), ("NEGATIVE", 0.8), ("NEGATIVE", 0.3)], "l string, s double")
    got = df.select(aspects.signed_score(F.col("l"), F.col("s")).alias("x")).collect()
    assert [(r.x["sentiment"], r.x["score"]) for r in got] == [("positive", 0.9), ("negative", -0.8), ("neutral", -0.3)]


@pytest.mark.parametrize("items, text", [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b and c")])
def test_listed(spark, items, text):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(replies.listed(F.col("x"))).first()[0] == text


@pytest.mark.parametrize("text, tidy", [
    ("hello   there", "Hello there."), ("Ok!", "Ok!"), ("", ""), ("a. b. c. d. e. f", "A. b. c. d."), ("a. b. c. d", "A. b. c. d."),
])
def test_tidy(texts, text, tidy):
    assert texts(text).select(replies.tidy(F.col("reviewText"))).first()[0] == tidy


def test_prompt_leaves_out_missing_facts(spark):
    df = spark.createDataFrame([("P", None, "", 4, None, "t")], "placeName string, placeAddress string, provider string, reviewRating int, authorName string, reviewText string")
    r = df.select(replies.prompt_context(F.lit("neutral")).alias("c"), replies.prompt(F.lit("neutral")).alias("p")).first()
    assert r.c == "Place: P | Rating: 4 | Sentiment: neutral" and "Reviewer" not in r.p


def test_quality_of_known_pairs(spark):
    pairs = [
        (1, "The soup was lovely, the queue took ages.", "neutral", "Thank you for your feedback. Here we value your input and note it."),
        (2, "Splendid evening, every course sang!", "amazing",
         "How glad we are! We truly appreciate the visit and your warm note, and we hope you come back soon with friends."),
        (3, "Worst evening ever. Burnt fish, rude host, never coming back.", "terrible",
         "We sincerely regret your ruined evening. Please contact the floor manager under floor@bistro.example so we can investigate at once and make it right."),
        (4, "x", "neutral", ""), (5, "x", "neutral", None), (6, "x", "neutral", "awesome, LOUD!!!!"),
    ]
    df = spark.createDataFrame(pairs, "review_id long, reviewText string, sentiment string, generated_response string")
    got = {r.review_id: r for r in reply_quality.score_replies(df).collect()}
    # 1: 3 (we value) + 1.5 (thank you) + 0.5 (we); 5 - 1.5 x 2 generic - 2 short; nothing to do; nothing amiss
    assert [got[1][f"{d}_score"] for d in ("empathy", "specificity", "actionability", "professionalism")] == [5.0, 0.0, 0.0, 10.0]
    # 2: 3 (we truly appreciate) + 1.5 (appreciate) + 3 x 0.5 (we) + 1 (one mark)
    assert (got[2].empathy_score, got[2].empathy_level) == (7.0, "high")
    # 3: 2 x (contact, investigate, make it right) + 3 resolution; "contact the" is no contact phrase
    assert got[3].actionability_score == 9.0
    # 5 + 2 x (manager) + 4 x 1/10 reused words (evening) - 2 for fewer than 25 words
    assert got[3].specificity_score == 5.4 and got[3].response_grade == "C"
    for i in (4, 5):
        assert (got[i].response_quality_score, got[i].response_grade, got[i].empathy_score) == (0.0, "F", None)
    # casual 1.5, no capital 1, !! 2, caps 2, brief 2
    assert got[6].professionalism_score == 1.5
    assert sum(r["count"] for r in reply_quality.grade_distribution(reply_quality.score_replies(df)).collect()) == 6


def test_expectations_of_partly_expected_rows(spark):
    rows = [(1, "positive", "positive", "positive", "negative", "positive", None), (2, "negative", None, "not_mentioned", "negative", "negative", "positive"),
            (3, None, "neutral", None, None, "neutral", None)]
    df = spark.createDataFrame(rows, "review_id long, sentiment string, expected_overall string, food_sentiment string, service_sentiment string, expected_food string, expected_service string")
    got = triage.expectations(df)
    assert [(r.passed, r.aspects_seen, r.aspects_right, r.aspects_failed) for r in got.orderBy("review_id").collect()] == [
        (True, 2, 2, ""), (True, 1, 0, "service"), (False, 0, 0, "")]
    total = triage.expectation_summary(got).first()
    assert (total.reviews, total.passed, total.failed, total.success_rate) == (3, 2, 1, 66.7)
    assert triage.expectation_summary(got.limit(0)).first().success_rate == 0.0


def test_wide_aspect_columns(spark):
    df = spark.createDataFrame([("positive", "negative", None)], "food_sentiment string, price_sentiment string, other string")
    r = replies.aspect_lists(df).first()
    assert (r.positive_aspects, r.negative_aspects) == (["food"], ["price"])
    none = replies.aspect_lists(spark.createDataFrame([("x",)], "other string")).first()
    assert (none.positive_aspects, none.negative_aspects) == ([], [])
