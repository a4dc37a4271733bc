"""Files whose records span lines, read by ranges: rows of the readers that take a whole file as one split."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.session import scratch_dir
from reviewlake.sources import ranged, readers, sinks

NAMES = ["a", "b", "c"]
ODD = [
    None, "", "plain", "a,b", 'say "hi"', '"', '""', '",', ',"', "line\nbreak", '"\n"', "\n", "\n\n,\"", "a\r\nb", " lead", "trail ", "x" * 700,
    "long\n" * 150, '"' * 9, "é😀\nü", "back\\slash", '\\"', "{", "}", '{"a":', "[", "]", "}\n{", '"}', "\t",
]


@pytest.fixture
def ranges(spark):
    """Make every file fall into ranges of the given size."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    values = [tuple(rng.choice(ODD) for _ in NAMES) for _ in range(200)]
    return spark.createDataFrame([v if any(v) else ("x", None, None) for v in values], "a string, b string, c string").coalesce(1)


def collected(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("size", [400, 5000, 1 << 20])
def test_csv_with_quoted_breaks(spark, rows, ranges, size):
    path = scratch_dir(spark, "csv")
    sinks.write_csv(rows, path)
    one_split = spark.read.schema(readers.string_schema(NAMES)).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").csv(path)
    ranges(size)
    got = readers.read_reviews_csv(spark, path, NAMES, multi_line=True)
    assert collected(got) == collected(one_split) == collected(rows)
    if size < 1 << 20:
        assert ranged.units(spark, path, ranged.Csv()).rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("size", [400, 5000, 1 << 20])
def test_json_arrays(spark, rows, ranges, size):
    path = scratch_dir(spark, "json")
    sinks.write_json_array(rows, path)
    one_split = spark.read.schema(readers.string_schema(NAMES)).option("multiLine", True).json(path)
    ranges(size)
    got = readers.read_reviews_json(spark, path, NAMES, array_file=True)
    assert collected(got) == collected(one_split) == collected(rows)
    if size < 1 << 20:
        assert ranged.units(spark, path, ranged.JsonArray()).rdd.getNumPartitions() >= 8


@pytest.fixture
def file(spark):
    """Write texts as they are, one folder each."""
    def write(*texts):
        paths = [scratch_dir(spark, "file") for _ in texts]
        for path, text in zip(paths, texts, strict=True):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
        return paths

    return write


@pytest.mark.parametrize("text", [
    'a,b,c\n1,"2\n3",4\n', 'a,b,c\r\n1,"2\n3",4\r\n"5","6","7"\r\n', 'a,b,c\n\n1,2,3\n\n4,5,6', '"a","b","c"\n5" disk,in"side,"x"\n1,"",\n', "a,b,c\n",
    '"a\nb",b,c\n1,2,3\n', 'a,b,c\n"x"" , ""y\n""",2,"3"\n,,\n"","",""\n', 'a,b,c\n1,2\n1,2,3,4\n"u\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\nv",,9',
])
def test_csv_as_one_split_reads_it(spark, file, ranges, text):
    """Blank lines, line ends of both kinds (kept inside quotes as they are), stray quotes, a header over two lines, missing
    and surplus fields."""
    path = file(text)
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\0"}
    expected = collected(spark.read.schema(readers.string_schema(NAMES)).options(**options).csv(path))
    for size in (5, 1 << 20):
        ranges(size)
        assert collected(readers.read_reviews_csv(spark, path, NAMES, multi_line=True)) == expected, size


def test_json_forms(spark, file, ranges):
    """Several arrays, pretty print, one line, nesting, numbers, a single object, empty arrays, escapes before braces."""
    values = [{"a": "}{\\", "b": '"}', "c": "\\\\}"}, {"a": "x", "b": None}, {"a": "é😀" * 40}]
    texts = [json.dumps(values), json.dumps(values, indent=2), "[]", " [ ] \n", json.dumps(values[0]), '[{"a":1,"b":{"x":{"y":[{"z":"}"}]}},"c":[{},{"q":"{"}]}]']
    path = file(*texts)
    expected = collected(spark.read.schema(readers.string_schema(NAMES)).option("multiLine", True).json(path))
    for size in (10, 60, 1 << 20):
        ranges(size)
        assert collected(readers.read_reviews_json(spark, path, NAMES, array_file=True)) == expected, size


def test_effects_compose_like_one_pass():
    """Effects of the parts of a text, composed, are those of the whole text."""
    rng = random.Random(4)
    for form, alphabet in ((ranged.Csv(), 'a",\r '), (ranged.JsonArray(), 'a"{[]\\,')):
        for _ in range(300):
            units = pa.array(["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))).replace("\\", "\\\\") for _ in range(rng.randint(1, 9))])
            to, up = form.effects(units)
            for inside in (0, 1):
                state, depths = ranged.trace(to, up, inside, 0)
                cut = rng.randint(0, len(units))
                first = ranged.trace(to[:, :cut], up[:, :cut], inside, 0)
                second = ranged.trace(to[:, cut:], up[:, cut:], int(first[0][-1]), int(first[1][-1]))
                assert (second[0][-1], second[1][-1]) == (state[-1], depths[-1])


def by_hand(text, inside):
    """Whether a line leads from outside or inside a quoted text to inside, character by character."""
    state = "quoted" if inside else "field"
    for ch in text:
        if state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if ch == '"' else "field" if ch == "," else "plain"
        elif ch == ",":
            state = "field"
        elif state == "field":
            state = "quoted" if ch == '"' else "plain"
    return state == "quoted"


def test_csv_effects_by_hand():
    rng = random.Random(5)
    lines = ["".join(rng.choice('a",') for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    to, _ = ranged.Csv().effects(pa.array(lines))
    assert [tuple(x) for x in to.T] == [(by_hand(t, False), by_hand(t, True)) for t in lines]


def test_changed_ranges_stop_the_read(spark):
    batch = pa.RecordBatch.from_pylist([{"value": "x", "file": "f", "start": 5, "inside": None, "depth": None, "owner": None}])
    with pytest.raises(RuntimeError, match="minPartitionNum"):
        list(ranged.range_records(iter([batch]), ranged.Csv()))


def test_states_beyond_the_broadcast_bound(spark, rows, ranges, monkeypatch):
    monkeypatch.setattr(ranged, "BROADCAST_RANGES", 3)
    path = scratch_dir(spark, "csv")
    sinks.write_csv(rows, path)
    ranges(500)
    assert collected(readers.read_reviews_csv(spark, path, NAMES, multi_line=True)) == collected(rows)
