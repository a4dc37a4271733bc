"""Conversation prefix trie: every distinct sequence of first turns, from adaptive radix trees over ranges of conversations.

A turn has an id of 16 bytes, big-endian and of fixed width: 12 bytes of a digest of role and text, and the length of its
text. A conversation is the string of its turns' ids; only these strings travel, never texts.

1. *Ranges.* The strings are sorted and cut into ranges of (string, conversation), so a conversation or a first turn that a
   third of all share is spread like anything else.
2. *Trees.* Each range is one adaptive radix tree: nodes of 4, 16, 48 or 256 children that grow as they fill, and paths
   without a fork compressed into a span of some key. Only byte depths at a whole turn emit nodes; a compressed path emits
   one for each turn on it.
3. *Borders.* In sorted order only prefixes of a range's first and last string can reach into another range. A range
   sends those two strings with what hangs on each prefix privately; they are merged by first turn, two rows for each range.
   All other nodes are final where they are made, but for the conversation that names a border parent, which is joined.
4. *Ends.* The digest of the conversations that end at a node is taken in the range, in sorted order. Where a string
   reaches a border, or very many conversations share it, ranges send pieces of up to a megabyte, and one sorted pass over
   the pieces of a string digests them as a stream.

Turn ids collide with probability n^2 / 2^97 for n turns. A range holds about four megabytes of ids, or one longer string;
range borders are sampled from at most 256 MB of strings.

Defined results: rows without a conv_id belong to no conversation; a null turn sorts first, and turns of equal number go
by id; repeated rows are turns of their own; null role or text is empty; c % 5 has the sign of c, as in SQL; an empty table
gives no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

WIDTH = 16
RANGE_BYTES = 4 << 20
SAMPLE_BYTES = 256 << 20
PIECE = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
RESULTS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


class Node:
    """A tree node: the bytes start..stop of `key`, children by their next byte in a layout of 4, 16, 48 or 256 places."""

    __slots__ = ("key", "start", "stop", "end", "places", "index", "children", "count", "least", "open", "leaves", "saved", "waiting")

    def __init__(self, key: bytes, start: int, stop: int, end: tuple | None = None):
        self.key, self.start, self.stop, self.end = key, start, stop, end
        self.places, self.index, self.children = 4, bytearray(), []
        self.count, self.least, self.open, self.leaves, self.saved, self.waiting = 0, None, 0, 0, 0, []

    def _at(self, byte: int) -> int:
        """Place of a child, or -1."""
        if self.places < 48:
            return self.index.find(byte)
        return byte if self.places == 256 else self.index[byte] - 1

    def child(self, byte: int) -> Node | None:
        at = self._at(byte)
        return self.children[at] if at >= 0 else None

    def replace(self, byte: int, node: Node) -> None:
        self.children[self._at(byte)] = node

    def add(self, byte: int, node: Node) -> None:
        if self.places < 256 and len(self.children) == self.places:
            self._grow()
        if self.places < 48:
            at = sum(b < byte for b in self.index)
            self.index.insert(at, byte)
            self.children.insert(at, node)
        elif self.places == 48:
            self.children.append(node)
            self.index[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.places, self.index = 48, index
        else:
            self.places, self.children = 256, [self.children[at - 1] if at else None for at in self.index]
            self.index = bytearray()

    def ordered(self) -> list[Node]:
        """Children by their byte."""
        if self.places < 48:
            return self.children
        if self.places == 48:
            return [self.children[at - 1] for at in self.index if at]
        return [c for c in self.children if c is not None]


def _shared(a: bytes, b: bytes, lo: int, hi: int) -> int:
    """First place in lo..hi where two keys differ; hi if none."""
    if a[lo:hi] == b[lo:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


class RadixTree:
    """Keys of whole turns with what ends at them."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def insert(self, key: bytes, end: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.add(key[at], Node(key, at, len(key), end))
                return
            reach = _shared(key, below.key, at, min(below.stop, len(key)))
            if reach < below.stop:  # the compressed path forks, or a key ends on it
                fork = Node(below.key, at, reach)
                node.replace(key[at], fork)
                below.start = reach
                fork.add(below.key[reach], below)
                below = fork
            node, at = below, reach
        node.end = end

    def path(self, key: bytes) -> list[Node]:
        node, out = self.root, []
        while node.stop < len(key):
            node = node.child(key[node.stop])
            out.append(node)
        return out

    def upwards(self) -> Iterator[tuple[Node, Node]]:
        """(node, parent), children before parents, without the root."""
        order, stack = [], [(c, self.root) for c in self.root.ordered()]
        while stack:
            node, parent = stack.pop()
            order.append((node, parent))
            stack += [(c, node) for c in node.ordered()]
        return reversed(order)


def _length(key: bytes, depth: int) -> int:
    """Bytes of the text of a key's turn number `depth`."""
    return int.from_bytes(key[depth * WIDTH - 4 : depth * WIDTH], "big")


def names(key: bytes, depths: range) -> list[bytes]:
    """Names of a key's prefixes of the given numbers of turns, at least one."""
    running = hashlib.sha256(key[: (depths.start - 1) * WIDTH])
    out = []
    for d in depths:
        running.update(key[(d - 1) * WIDTH : d * WIDTH])
        out.append(running.digest()[:16])
    return out


_LONGS = pa.list_(pa.int64())
_FOUND = pa.schema([
    ("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("text", pa.binary()), ("since", pa.int32()), ("counts", _LONGS), ("least", _LONGS), ("children", _LONGS), ("leaves", _LONGS), ("saved", _LONGS),
    ("ends", pa.list_(pa.string())),
])
FOUND = (
    "kind int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, text binary, since int, counts array<bigint>, least array<bigint>, children array<bigint>, "
    "leaves array<bigint>, saved array<bigint>, ends array<string>"
)
NODE, BORDER, PIECES = range(3)
OPEN = "?"  # what ends here is digested from pieces


def _batch(rows: list[dict], schema: pa.Schema = _FOUND) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _piece(key: bytes, ids: list[int]) -> dict:
    return {"kind": PIECES, "node": hashlib.sha256(key).digest()[:16], "conv_id": ids[0], "text": ",".join(map(str, ids)).encode()}


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[RadixTree | list[dict]]:
    """Pieces of border strings and of often repeated ones as they come; at last the tree of the range, with its first and last key."""
    tree, first, key, ids, n, least, sent, size = RadixTree(), None, None, [], 0, None, False, 0

    def close(last: bool) -> Iterator[list[dict]]:
        nonlocal sent
        if sent or last or key == first or key == b"":
            if ids:
                yield [_piece(key, ids)]
            sent = True
        if key:
            tree.insert(key, (n, least, OPEN if sent else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))

    for k, conv in _keys(batches):
        if k != key:
            if key is not None:
                yield from close(False)
            first = k if not first else first
            key, ids, n, least, sent, size = k, [], 0, conv, False, 0
        ids.append(conv)
        n += 1
        size += 20
        if size >= PIECE:
            yield [_piece(key, ids)]
            ids, sent, size = [], True, 0
    if key is not None:
        yield from close(True)
        tree.ends = (first, key)
        yield tree


def _nodes(tree: RadixTree, root_conv: int) -> Iterator[list[dict]]:
    """Final nodes of a range, and the rows of its first and last key."""
    first, last = tree.ends
    border = {id(n) for k in (first, last) for n in tree.path(k)}
    rows: list[dict] = []
    kept: dict[int, dict[int, tuple]] = {}  # of border nodes, by depth: what hangs on them privately
    for node, parent in tree.upwards():
        if node.end:
            node.count += node.end[0]
            node.least = node.end[1] if node.least is None else min(node.least, node.end[1])
        parent.count += node.count
        parent.least = node.least if parent.least is None else min(parent.least, node.least)
        mine = id(node) in border
        for depth in range(node.stop // WIDTH, node.start // WIDTH, -1):
            ends = node.end[2] if node.end and depth * WIDTH == node.stop else EMPTY
            if mine:
                kept.setdefault(id(node), {})[depth] = (node.count, node.least, node.open, node.leaves, node.saved, ends)
                if node.waiting:
                    name = names(node.key[: depth * WIDTH], range(depth, depth + 1))[0]
                    for row in node.waiting:
                        row["parent"] = name
                node.open, node.leaves, node.saved, node.waiting = 0, 0, 0, []
                continue
            for row in node.waiting:
                row["parent_conv_id"] = node.least
            node.leaves = node.leaves if node.open else 1
            node.saved += (node.count - 1) * _length(node.key, depth)
            row = {
                "kind": NODE, "conv_id": node.least, "depth": depth, "n_convs": node.count, "n_children": node.open, "n_leaves": node.leaves,
                "saved_tokens": node.saved, "ends_sha256": ends, "parent_conv_id": root_conv if depth == 1 else None,
            }
            if ends == OPEN:
                row |= {"ends_sha256": None, "node": names(node.key[: depth * WIDTH], range(depth, depth + 1))[0]}
            rows.append(row)
            node.open, node.waiting = 1, [row] if depth > 1 else []
        parent.open += node.open
        parent.leaves += node.leaves
        parent.saved += node.saved
        parent.waiting += node.waiting
    for at in range(0, len(rows), 4096):
        yield rows[at : at + 4096]
    since = 1
    for key in dict.fromkeys((first, last)):
        facts = [fact for n in tree.path(key) for _, fact in sorted(kept.get(id(n), {}).items())][since - 1 :]
        if facts:
            columns = dict(zip(("counts", "least", "children", "leaves", "saved", "ends"), map(list, zip(*facts, strict=True)), strict=True))
            yield [{"kind": BORDER, "node": key[:WIDTH], "text": key, "since": since} | columns]
        since = 1 + _shared(first, last, 0, min(len(first), len(last))) // WIDTH


def ranges(batches: Iterator[pa.RecordBatch], root_conv: int) -> Iterator[pa.RecordBatch]:
    for got in _tree(batches):
        for rows in [got] if isinstance(got, list) else _nodes(got, root_conv) if got.ends[1] else []:
            yield _batch(rows)


def merge(table: pa.Table, root_conv: int) -> pa.Table:
    """Border nodes below one first turn, from the two strings of each range."""
    met: dict[bytes, list] = {}
    for row in table.to_pylist():
        key, since = row["text"], row["since"]
        facts = zip(row["counts"], row["least"], row["children"], row["leaves"], row["saved"], row["ends"], strict=True)
        above = names(key, range(since - 1, since))[0] if since > 1 else b""
        for depth, name, (count, least, children, leaves, saved, ends) in zip(range(since, since + len(row["ends"])), names(key, range(since, since + len(row["ends"]))), facts, strict=True):
            got = met.setdefault(name, [depth, above, 0, least, 0, 0, 0, EMPTY, _length(key, depth)])
            got[2] += count
            got[3] = min(got[3], least)
            got[4] += children
            got[5] += leaves
            got[6] += saved
            got[7] = got[7] if ends == EMPTY else ends
            above = name
    out = []
    for name, (depth, above, count, least, children, leaves, saved, ends, length) in sorted(met.items(), key=lambda x: -x[1][0]):
        leaves, saved = leaves if children else 1, saved + (count - 1) * length
        out.append({
            "node": name, "conv_id": least, "depth": depth, "parent_conv_id": met[above][3] if above else root_conv, "n_convs": count,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": None if ends == OPEN else ends,
        })
        if above:
            up = met[above]
            up[4], up[5], up[6] = up[4] + 1, up[5] + leaves, up[6] + saved
    return pa.Table.from_pylist(out, schema=_MERGED)


_MERGED = pa.schema([f for f in _FOUND if f.name in ("node", *RESULTS)])
MERGED = "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_ENDS = pa.schema([("node", pa.binary()), ("digest", pa.string())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first conversation, digested as a stream."""
    node, running = None, None
    for batch in batches:
        out = []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    out.append({"node": node, "digest": running.hexdigest()})
                node, running = name, hashlib.sha256(text)
            else:
                running.update(b"," + text)
        yield _batch(out, _ENDS)
    if node is not None:
        yield _batch([{"node": node, "digest": running.hexdigest()}], _ENDS)


def rebuilt(turns: DataFrame) -> DataFrame:
    """(key, conv_id): the ids of every conversation's rebuilt turns, one after the other."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(24))
    turn = F.struct("turn", F.concat(name, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")).alias("id"))
    own = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    own = C.settled(own.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["id"]), "")).alias("key")), "conversations")
    heads = own.filter(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.substring("key", 1, 8 * WIDTH).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9 * WIDTH).cast("int")
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    none = F.lit(b"")
    key = F.concat(F.substring(F.coalesce("head", none), F.lit(1), taken), F.substring("key", taken + 1, F.greatest(F.length("key") - taken, F.lit(0))))
    return joined.select(key.alias("key"), "conv_id")


def trie(turns: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each node, of turns (conv_id, turn, role, text)."""
    strings = C.settled(rebuilt(turns), "rebuilt")
    total, convs, root_conv = strings.agg(F.coalesce(F.sum(F.length("key").cast("long")), F.lit(0)), F.count(F.lit(1)), F.min("conv_id")).first()
    mean = total / max(convs, 1)
    parts = max(1, math.ceil((total + 16 * convs) / range_bytes))
    if 1e6 * mean > SAMPLE_BYTES:  # long strings: fewer borders, so that the sample for them stays small
        parts = max(1, min(parts, int(SAMPLE_BYTES / (100 * mean))))
    dealt = strings.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = C.settled(dealt.mapInArrow(lambda batches: ranges(batches, root_conv), FOUND), "ranges")
    border = found.filter(F.col("kind") == BORDER).select("node", "text", "since", "counts", "least", "children", "leaves", "saved", "ends")
    border = C.settled(border.groupBy("node").applyInArrow(lambda table: merge(table, root_conv), MERGED), "border")
    pieces = found.filter(F.col("kind") == PIECES).select("node", "text", "conv_id")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "text")
    ends = C.settled(pieces.mapInArrow(digests, "node binary, digest string"), "ends")
    made = found.filter(F.col("kind") == NODE)
    whole = made.filter(F.col("parent").isNull() & F.col("node").isNull()).select(*RESULTS)
    names_ = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("__conv"))
    late = made.filter(F.col("parent").isNotNull() | F.col("node").isNotNull()).join(names_, "parent", "left")
    late = late.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__conv")).select("node", *RESULTS)
    late = late.unionByName(border).join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "digest")).select(*RESULTS)
    below = whole.unionByName(late)
    tops = border.select(*RESULTS).unionByName(made.select(*RESULTS)).filter(F.col("depth") == 1)
    root = tops.agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    at_root = ends.filter(F.col("node") == F.lit(hashlib.sha256(b"").digest()[:16])).first()
    none = F.lit(None).cast("long")
    root = root.withColumn("ends_sha256", F.lit(at_root.digest if at_root else EMPTY)).limit(1 if convs else 0)
    root = root.withColumns({"conv_id": F.lit(root_conv).cast("long"), "depth": F.lit(0).cast("long"), "parent_conv_id": none, "n_convs": F.lit(convs).cast("long")})
    return below.unionByName(root.select(*RESULTS))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `conversations`."""
    return trie(C.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


def oracle_sql() -> str:
    """Every prefix of every rebuilt conversation as a list, and every node with each of its ancestors."""
    step = "CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {step})), 4294967295)"
    return f"""WITH own AS MATERIALIZED (
            SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p FROM (
                SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 24) || printf('%08x', strlen(coalesce(text, ''))) AS id
                FROM conversations WHERE conv_id IS NOT NULL)),
        sizes AS MATERIALIZED (SELECT conv_id, count(*) AS n, CAST({crc} AS BIGINT) % 9 AS h FROM own GROUP BY conv_id),
        turns AS MATERIALIZED (
            SELECT s.conv_id, o.p, o.id FROM sizes s JOIN own o ON o.conv_id = s.conv_id - s.conv_id % 5 AND o.p <= s.h
            UNION ALL
            SELECT s.conv_id, 8 + o.p, o.id FROM sizes s JOIN own o ON o.conv_id = s.conv_id AND o.p > s.h),
        paths AS MATERIALIZED (SELECT conv_id, coalesce(list(id ORDER BY p) FILTER (id IS NOT NULL), []) AS path FROM sizes LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
        nodes AS MATERIALIZED (
            SELECT path[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
            FROM paths, range(0, 100000) r(d) WHERE d <= len(path) GROUP BY ALL),
        children AS MATERIALIZED (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        known AS MATERIALIZED (
            SELECT n.*, coalesce(n_children, 0) AS n_children,
                CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * CAST('0x' || right(node[depth], 8) AS BIGINT) END AS saved
            FROM nodes n LEFT JOIN children USING (node)),
        trees AS MATERIALIZED (
            SELECT node[1:a] AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM known, range(0, 100000) r(a) WHERE a <= depth GROUP BY ALL)
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves, t.saved_tokens, k.ends_sha256
        FROM known k JOIN trees t USING (node) LEFT JOIN known p ON k.depth > 0 AND p.node = k.node[1:k.depth - 1]"""
