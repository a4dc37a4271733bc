"""Plain versions of the operators, by definition and without Spark."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


def shingles(w, k=5):
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def held(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def repeats(rows, length):
    """(id, bytes, removed, spans, sha256 of the kept bytes, kept bytes), sorted."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = len([m for m in re.finditer(b"\1+", bytes(covered))])
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def near(rows, threshold=0.8):
    """(id, class id, links) of every row, in order of rows; and the row that stays of each group."""
    sets = [frozenset(shingles(words(t))) for _, t in rows]
    parent, links, having = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, s in enumerate(sets):
        both = Counter(k for x in s for k in having[x])
        for k, n in both.items():
            if n >= threshold * (len(s) + len(sets[k]) - n) - 1e-9:
                links[j] += 1
                links[k] += 1
                parent[find(j)] = find(k)
        for x in s:
            having[x].append(j)
    least = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            least[find(j)] = min(i, least.get(find(j), i))
    return [(i, least.get(find(j)) if sets[j] else i, links[j]) for j, (i, _) in enumerate(rows)], [find(j) if sets[j] else (j,) for j in range(len(rows))]


def leaks(rows, items, threshold=0.8):
    """(id, item, similarity of the best window), sorted."""
    items = [(i, words(t)) for i, t in items]
    items = [(i, w, set(shingles(w))) for i, w in items if w]
    having = Counter(x for _, _, s in items for x in s)
    weigh = lambda xs: sum(math.log1p(len(items) / having[x]) if x in having else math.log1p(len(items)) for x in xs)
    out = []
    for i, t in rows:
        w = words(t)
        for item, own, s in items:
            if not w or not s & set(shingles(w, min(5, len(own)))):
                continue
            best = 0
            for at in range(max(0, len(w) - len(own)) + 1):
                window = w[at : at + len(own)]
                x = set(shingles(window))
                both = weigh(x & s)
                best = max(best, both / (weigh(s) + weigh(x) - both))
            if best >= threshold - 1e-9:
                out.append((i, item, round(best, 6)))
    return sorted(out)
