import pytest
from pyspark.sql import functions as F

from reviewlake.functions.text import clean_text, is_blank, word_count
from reviewlake.operators import cleaning
from reviewlake.session import scratch_dir
from reviewlake.sources import readers, sinks

RAW = "placeName string, placeAddress string, provider string, reviewText string, reviewDate string, reviewRating string, authorName string"
NAMES = RAW.replace(" string", "").split(", ")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("text, expected", [
    ("Hello World!", "hello world!"),
    ("Test@123#$%", "test123"),
    ("http://example.com text", "text"),
    ("<b>bold</b> text", "bold text"),
    (None, ""),
    ("   spaces   everywhere   ", "spaces everywhere"),
    ("UPPERCASE", "uppercase"),
    ("a  b\n\tc", "a b c"),
    ("see www.x.org/a?b now", "see now"),
    ("café – ok", "caf ok"),
    ("1 < 2\n3 > 2", "1 2 3 2"),
    ("a_b^c`d{e}|f~g\\h[i]j-k", "abcdefghijk"),
])
def test_clean_text(texts, text, expected):
    assert texts(text).select(clean_text(F.col("reviewText"))).first()[0] == expected


def test_blank_and_word_count(texts):
    df = texts(None, "", "  \t", "one  two\nthree ").orderBy("review_id")
    assert [r[0] for r in df.select(is_blank(F.col("reviewText"))).collect()] == [True, True, True, False]
    assert df.filter("review_id = 4").select(word_count(F.col("reviewText"))).first()[0] == 3


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([
        ("A", "x", "P", "Good", "2024-01-01", "5", "a"),
        ("A", "x", "P", None, "bad date", None, "b"),
        ("B", "y", "P", "  ", "2024-02-01", "1", "c"),
        ("B", "y", "P", "Ok", "2024-02-01", "9", "d"),
        ("B", "y", "P", "Ok", "2024-02-01", "4.9", "d"),
        ("B", "y", "P", "Ok", "2024-02-01", "none", "d"),
        tuple(NAMES),
    ], RAW)


def test_strict_cleaning(raw):
    got = sorted(rows(cleaning.clean_reviews(raw), "reviewRating", "reviewText", "placeName"))
    assert got == [(1, "this was the worst experience ive had.", "B"), (4, "ok", "B"), (5, "good", "A")]


def test_lenient_cleaning_keeps_out_of_range(raw):
    assert sorted(r[0] for r in rows(cleaning.clean_lenient(raw), "reviewRating")) == [1, 4, 5, 9]


def test_missing_columns_are_named(raw):
    with pytest.raises(ValueError, match="authorName, reviewDate"):
        cleaning.require_columns(raw.drop("reviewDate", "authorName"))


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="unknown source"):
        readers.acquire(spark, "x", "carrier pigeon", multi_line=False)


def test_training_rows(raw):
    assert sorted(r[0] for r in rows(cleaning.training_rows(raw), "reviewText")) == ["  ", "Good", "Ok", "Ok"]


def test_exact_duplicates_and_lengths(spark):
    df = spark.createDataFrame([("a", "x" * 9), ("a", "x" * 9), ("b", "x" * 10)], "k string, reviewText string")
    assert cleaning.drop_exact_duplicates(df, ["k", "reviewText"]).count() == 2
    assert cleaning.keep_text_lengths(df).count() == 1


def test_csv_keeps_null_empty_and_line_breaks(spark):
    df = spark.createDataFrame([("a\n\"b\",c",), ("",), (None,), ("  x ",), ("NA",)], "reviewText string")
    path = scratch_dir(spark, "test")
    sinks.write_csv(df.coalesce(1).withColumn("k", F.lit("k")), path)
    back = readers.read_reviews_csv(spark, path, ["reviewText", "k"], multi_line=True)
    assert sorted(r[0] or str(r[0]) for r in rows(back, "reviewText")) == sorted(["a\n\"b\",c", "", "None", "  x ", "NA"])
    assert readers.nullify(back).filter("reviewText IS NULL").count() == 3


def test_json_array_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"reviewText": "a", "reviewRating": "5"}, {"reviewText": "b"}]')
    assert readers.read_reviews_json(spark, str(tmp_path), array_file=True).count() == 2


def test_pages_fall_back_to_text(spark):
    page = '{"reviews": [{"user": {"name": "u"}, "rating": 4, "snippet": "", "text": "t"}, {"snippet": "s"}, {}]}'
    df = readers.flatten_pages(spark.createDataFrame([(1, page)], "page_id long, page string"))
    assert sorted(rows(df, "reviewText")) == [("",), ("s",), ("t",)]
