"""Files whose records span lines, read in parallel by byte ranges.

Spark's own readers take such a file (quoted line breaks in CSV, one JSON array) as a single split. Here Spark cuts it at
separators wherever it likes, and two passes find the records:

1. A range does not know whether it begins inside a quoted text or how deep in nested objects. It reports what it does to
   either state: where it leads from outside and from inside, how the depth changes, and whether a record ends in it. These
   effects compose, so a pass over one small row for each range gives every range its true state at its start.
2. Each range then yields the records that lie within it. A record that crosses borders is sent as fragments, named by the
   range where it began, and joined; its length is not limited by that of a range.

Records are parsed by `from_csv` and `from_json`, with the options of the file readers. No row order is kept, as in any
scan. Both passes must see the same ranges; a read stops if they differ (set `spark.sql.files.minPartitionNum` where the
number of cores changes during a read).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.session import settled, ship_package

NEVER = 1 << 40
#: Ranges whose states are broadcast: about 100 bytes each, so at most 50 MB. More are joined by a shuffle.
BROADCAST_RANGES = 500_000

EFFECTS = "file string, start bigint, to_out int, to_in int, up_out bigint, up_in bigint, low_out bigint, low_in bigint"
STATES = "file string, start bigint, inside int, depth bigint, owner bigint"
RECORDS = "fragment boolean, file string, owner bigint, start bigint, header boolean, text string"
_EFFECTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("to_out", pa.int32()), ("to_in", pa.int32()), *[(c, pa.int64()) for c in ("up_out", "up_in", "low_out", "low_in")]])
_STATES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.int32()), ("depth", pa.int64()), ("owner", pa.int64())])
_RECORDS = pa.schema([("fragment", pa.bool_()), ("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("header", pa.bool_()), ("text", pa.string())])


@dataclass(frozen=True)
class Csv:
    """Units are lines. A quote opens a text only at the start of a field; a doubled one inside does not close it."""

    delimiter: str = ","
    header: bool = True
    separator = "\n"

    def effects(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """From outside and from inside a quoted text: whether each unit ends inside, and its change of depth."""
        d = {"\t": r"\t"}.get(self.delimiter, "\\" + self.delimiter)
        rest = rf'(?:[^"{d}][^{d}]*)?'
        field = rf'(?:"(?:[^"]|"")*"{rest}|[^"{d}][^{d}]*)?'
        opened = rf'(?:{field}{d})*"(?:[^"]|"")*$'
        to = np.zeros((2, len(units)), np.int8)
        to[1] = 1
        quoted = np.flatnonzero(pc.match_substring(units, '"').to_numpy(zero_copy_only=False))
        if len(quoted):
            some = units.take(pa.array(quoted))
            hits = lambda p: pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False)
            to[0, quoted] = hits(f"(?s)^{opened}")
            to[1, quoted] = hits(rf'(?s)^(?:[^"]|"")*(?:"{rest}{d}{opened}|$)')
        return to, np.zeros((2, len(units)), np.int64)

    def begins(self, units: pa.Array) -> np.ndarray:
        return np.ones(len(units), bool)

    def record(self, units: list[str]) -> str:
        return "\n".join(units).removesuffix("\r")

    def parse(self, schema: T.StructType, options: dict[str, str]):
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return F.from_csv("text", ddl, {"sep": self.delimiter, "multiLine": "true"} | options)


@dataclass(frozen=True)
class JsonArray:
    """Units end at closing braces. Braces inside strings are text; a record is an object that no other object holds."""

    header = False
    separator = "}"

    def effects(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.replace_substring_regex(units, r"(?s)\\.", "")
        quotes = pc.count_substring(plain, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        to = np.stack([quotes % 2, 1 - quotes % 2]).astype(np.int8)
        outside = pc.replace_substring_regex(plain, r'(?s)"[^"]*(?:"|$)', "")
        after = pc.replace_substring_regex(pc.replace_substring_regex(plain, r'(?s)^[^"]*(?:"|$)', ""), r'(?s)"[^"]*(?:"|$)', "")
        up = np.stack([pc.count_substring(x, "{").to_numpy(zero_copy_only=False).astype(np.int64) for x in (outside, after)])
        return to, up - (to == 0)

    def begins(self, units: pa.Array) -> np.ndarray:
        return pc.match_substring(units, "{").to_numpy(zero_copy_only=False)

    def record(self, units: list[str]) -> str:
        text = "}".join(units) + "}"
        return text[text.index("{") :] if "{" in text else ""

    def parse(self, schema: T.StructType, options: dict[str, str]):
        return F.from_json("text", schema, options)


def trace(to: np.ndarray, up: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """State before each unit and after the last one: inside or not, and depth."""
    n = to.shape[1]
    state = np.empty(n + 1, np.int8)
    at = 0
    for i in np.flatnonzero((to[0] != 0) | (to[1] != 1)).tolist():
        state[at : i + 1] = inside
        inside, at = int(to[inside, i]), i + 1
    state[at:] = inside
    depths = np.full(n + 1, depth, np.int64)
    depths[1:] += np.cumsum(up[state[:n], np.arange(n)])
    return state, depths


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the range changes, with (file, start, ...) of the range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(2).to_numpy()
        files = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(lo, hi - lo)
            yield tuple(part.column(c)[0].as_py() for c in range(1, part.num_columns)), part


def range_effects(batches: Iterator[pa.RecordBatch], form) -> Iterator[pa.RecordBatch]:
    """One row for each range: what it does to either state."""
    key, facts = None, []

    def row() -> pa.RecordBatch:
        (o, od, ol), (i, id_, il) = facts
        return pa.RecordBatch.from_pylist([dict(zip(_EFFECTS.names, (*key, o, i, od, id_, ol, il), strict=True))], schema=_EFFECTS)

    for (file, start), part in _runs(batches):
        if (file, start) != key:
            if key:
                yield row()
            key, facts = (file, start), [(0, 0, NEVER), (1, 0, NEVER)]
        to, up = form.effects(part.column(0))
        for j, (inside, depth, low) in enumerate(facts):
            state, depths = trace(to, up, inside, depth)
            out = depths[1:][state[1:] == 0]
            facts[j] = (int(state[-1]), int(depths[-1]), min(low, int(out.min(initial=NEVER))))
    if key:
        yield row()


def compose(table: pa.Table) -> pa.Table:
    """The ranges of one file: true state at each start, and the range where a record open there began."""
    out, inside, depth, owner = [], 0, 0, None
    for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
        clean = not inside and depth <= 0
        out.append({"file": r["file"], "start": r["start"], "inside": inside, "depth": depth, "owner": None if clean else owner})
        to, up, low = (r["to_in"], r["up_in"], r["low_in"]) if inside else (r["to_out"], r["up_out"], r["low_out"])
        if clean or depth + low <= 0:
            owner = r["start"]
        inside, depth = to, depth + up
    return pa.Table.from_pylist(out, schema=_STATES)


class _Records:
    """Cuts the units of one range into records and border fragments."""

    def __init__(self, form, file: str, start: int, inside: int | None, depth: int | None, owner: int | None):
        if inside is None:
            raise RuntimeError(f"the ranges of {file} differ between two passes: set spark.sql.files.minPartitionNum")
        self.form, self.file, self.start, self.inside, self.depth = form, file, start, inside, depth
        self.owner = owner  # of the open record; None between records
        self.units: list[str] = []
        self.header = form.header and start == 0

    def add(self, units: pa.Array) -> list[dict]:
        to, up = self.form.effects(units)
        state, depths = trace(to, up, self.inside, self.depth)
        clean = (state == 0) & (depths <= 0)
        begins = clean[:-1] & self.form.begins(units)
        values = units.to_pylist()
        out = []
        stops = np.flatnonzero(clean[1:])
        at = 0
        for stop in stops.tolist():  # the unit after which nothing is open
            if self.owner is not None or self.units or begins[at]:
                out.append(self._close(values[at : stop + 1]))
            at = stop + 1
        if at < len(values):
            self.units += values[at:]
            self.owner = self.start if self.owner is None else self.owner
        self.inside, self.depth = int(state[-1]), int(depths[-1])
        return [r for r in out if r]

    def _row(self, fragment: bool, text: str) -> dict:
        return {"fragment": fragment, "file": self.file, "owner": self.owner, "start": self.start, "header": self.header, "text": text}

    def _close(self, units: list[str]) -> dict | None:
        foreign = self.owner is not None and self.owner != self.start
        units, self.units = self.units + units, []
        row = self._row(foreign, self.form.separator.join(units) if foreign else self.form.record(units))
        self.owner = None
        if not foreign:
            if not row["text"]:
                return None
            if self.header:
                self.header = False
                return None
        return row

    def rest(self) -> list[dict]:
        """A record still open at the end of the range."""
        return [self._row(True, self.form.separator.join(self.units))] if self.units else []


def range_records(batches: Iterator[pa.RecordBatch], form) -> Iterator[pa.RecordBatch]:
    open_range, key = None, None
    for (file, start, *state), part in _runs(batches):
        rows = []
        if (file, start) != key:
            rows += open_range.rest() if open_range else []
            key, open_range = (file, start), _Records(form, file, start, *state)
        rows += open_range.add(part.column(0))
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
    if open_range:
        yield pa.RecordBatch.from_pylist(open_range.rest(), schema=_RECORDS)


def units(spark: SparkSession, path: str | Sequence[str], form) -> DataFrame:
    """(value, file, start of the range); rows of a range are in the order of the file."""
    text = spark.read.option("lineSep", form.separator).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def records(spark: SparkSession, path: str | Sequence[str], form) -> DataFrame:
    """One row `text` for each record of the files."""
    ship_package(spark)
    parts = units(spark, path, form)
    effects = parts.mapInArrow(lambda batches: range_effects(batches, form), EFFECTS)
    states = settled(effects.groupBy("file").applyInArrow(compose, STATES), "ranges")
    if states.count() <= BROADCAST_RANGES:
        placed = parts.join(F.broadcast(states), ["file", "start"], "left")
    else:
        placed = parts.withColumn("__line", F.monotonically_increasing_id()).join(states, ["file", "start"], "left")
        placed = placed.sortWithinPartitions("file", "start", "__line")
    placed = placed.select("value", "file", "start", "inside", "depth", "owner")
    found = placed.mapInArrow(lambda batches: range_records(batches, form), RECORDS)
    whole = found.filter(~F.col("fragment")).select("text")
    pieces = found.filter("fragment").groupBy("file", "owner").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("pieces")
    )
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), form.separator)
    if form.separator == "}":
        text = F.regexp_extract(F.concat(joined, F.lit("}")), r"(?s)^[^{]*(\{.*)$", 1)
    else:
        text = F.regexp_replace(joined, r"\r\z", "")
    crossing = pieces.filter(~F.col("header")).select(text.alias("text")).filter(F.col("text") != "")
    return whole.unionByName(crossing)


def read(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, form, options: dict[str, str] | None = None) -> DataFrame:
    """Typed rows of CSV or JSON array files, in as many tasks as the files have splits."""
    parsed = records(spark, path, form).select(form.parse(schema, options or {}).alias("r"))
    return parsed.select(*[F.col("r")[f.name].alias(f.name) for f in schema])
