"""The trie of prefixes against dictionaries of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from reviewlake.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def name(role, text):
    body = text.encode()
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:24] + f"{len(body):08x}"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, name(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    least = lambda node: min(members[node])
    return [(least(n), len(n), least(n[:-1]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n], digest(ends[n])) for n in members]


def corpus(seed=2, convs=300):
    rng = random.Random(seed)
    said = ["", "hi", "hallo é", "😀 ok", "x" * 300, "why", "no", "yes"]
    rows = []
    for c in range(convs):
        start = rng.choice(["hi", "hi", f"opening {c}"])
        rows.append((c, 0, "user", start))
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(said) if rng.random() < 0.7 else f"{c} {t}") for t in range(1, rng.choice([1, 2, 4, 9, 14]))]
    for c in range(1000, 1200):  # one conversation, very often
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    for c in (2000, 2001, 2003):  # deep ones that part late
        rows += [(c, t, "bot", f"deep {t}" if t < 150 else f"{c} {t}") for t in range(180)]
    rows += [(c, 3, "user", "short") for c in (3001, 3002, 3006, 3007, 3008, 3009, 3011)]  # no base: turnless unless h is 0
    rows += [(-7, 1, "user", "hi"), (-5, 0, "user", "hi"), (4000, None, None, None), (4000, 1, "user", None), (4000, 1, None, "user"), (4000, 1, None, "user")]
    rows += [(None, 0, "user", "nobody's"), (4001, -3, "", "hi"), (10**15, 0, "user", "hi"), (4002, 0, "us", "erhi"), (4003, 0, "user", "hi")]
    rng.shuffle(rows)
    return rows


def key(row):
    return row[1], row[0], row[2] or 0, *row[3:]


@pytest.fixture
def turns(spark, docs):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(("range_bytes", "piece"), [(T.RANGE_BYTES, T.PIECE), (5000, 200), (600, T.PIECE)])
def test_equals_plain_prefixes(turns, monkeypatch, range_bytes, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    rows = corpus()
    got = T.trie(turns(rows), range_bytes)
    assert tuple(got.columns) == T.RESULTS and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_small_tables(turns):
    for rows in ([(0, 0, "user", "hi")], [(3001, 0, "user", "x")], [(c, 0, "user", "hi") for c in range(40)]):
        assert sorted(map(tuple, T.trie(turns(rows)).collect()), key=key) == sorted(plain(rows), key=key)
    assert T.trie(turns([])).count() == 0 and T.trie(turns([(None, 0, "user", "hi")])).count() == 0


def test_layouts_grow_and_keep_order():
    rng = random.Random(7)
    keys = {bytes([rng.randrange(256) for _ in range(rng.choice([1, 1, 2, 3]))]) for _ in range(3000)} | {b"long" * 40, b"long" * 39 + b"lonx", b"long"}
    tree = T.RadixTree()
    seen = set()
    for k in rng.sample(sorted(keys), len(keys)):
        tree.insert(k, (1, len(k), k))
        seen.add(tree.root.places)
    assert seen == {4, 16, 48, 256}
    out, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        assert node.places in (4, 16, 48, 256) and len(node.ordered()) <= node.places
        if node.end:
            out.append(node.end[2])
        stack += reversed(node.ordered())
    assert out == sorted(keys)
    assert tree.path(b"long" * 40)[-1].end[2] == b"long" * 40
