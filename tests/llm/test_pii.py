"""Spans and disclosing terms against a plain version over whole texts."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
import regex
from reviewlake.llm import pii as P

SCHEMA = "doc_id long, text string"


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    spans = []
    for kind, pattern in P.PLAIN.items():
        for m in re.finditer(pattern, text):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, v.split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, *m.span(), f"{kind}:{v.lower() if kind == 'email' else v if kind == 'ip' else digits}"))
    return spans


def beside(kind, text, reach):
    """Per match of the plain pattern: its start and the terms within reach, between it and the neighbouring matches."""
    found = list(re.finditer(P.PLAIN[kind], text))
    for m, left, right in zip(found, [0, *[x.end() for x in found]], [*[x.start() for x in found[1:]], len(text)], strict=False):
        inside = {w.span(): w.group() for w in regex.finditer(r"\p{L}+", text[left : m.start()])}
        after = {w.span(): w.group() for w in regex.finditer(r"\p{L}+", text[m.end() : right])}
        size = m.start() - left
        words = {w for (a, b), w in inside.items() if b < size and a >= size - reach and (size <= reach or a > size - reach or not regex.match(r"\p{L}", text[m.start() - reach]))}
        size = right - m.end()
        words |= {w for (a, b), w in after.items() if a > 0 and b <= reach and (size <= reach or b < reach)}
        yield m.start(), {w for w in words if len(w) >= 3}


def plain(rows, support, threshold, reach):
    texts = {t or "" for _, t in rows}
    base = {t: plain_base(t) for t in texts}
    n_e, n_et, held = Counter(), Counter(), defaultdict(set)
    for t in texts:
        n_e.update({e for *_, e in base[t]})
        at = {(k, s): e for k, s, _, e in base[t]}
        n_et.update({(at[k, s], w) for k in P.PLAIN for s, words in beside(k, t, reach) if (k, s) in at for w in words})
        for w in set(regex.findall(r"\p{L}{3,}", t)):
            held[w].add(t)
    told = lambda e, n, w: math.log(len(texts) * n / (n_e[e] * len(held[w]))) / math.log(len(texts) / n_e[e])
    strong = {w for (e, w), n in n_et.items() if n >= support and n_e[e] < len(texts) and told(e, n, w) >= threshold}
    out = []
    for i, t in rows:
        t = t or ""
        terms = [("term", *m.span()) for m in regex.finditer(r"\p{L}+", t) if m.group() in strong]
        terms = [x for x in terms if not any(b[1] < x[2] and b[2] > x[1] for b in base[t])]
        write = lambda spans: ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)
        counts = [sum(b[0] == k for b in base[t]) for k in P.PLAIN]
        out.append((i, *counts, hashlib.sha256(write(base[t]).encode()).hexdigest(), write(base[t] + terms)))
    return out, strong


def found(df, **more):
    rows = P.sanitise(df, **more)
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", P.F.array_join(P.written(P.F.col("spans")), ",").alias("spans"))


ODD = [
    "a@b.c a@b.c_d@e.f %x@y.z.w. q@r", "é.und@mail7.example.com chaîne.x@a-b.co", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1..2.3.4", "a@b@c.d@e.f.g",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "+1 (017) 555-7713 2023 +1234567 +++49 30 1234 5678)", "12 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
    "😀 x@y.zz 😀😀 +49 151 2345678 😀", "+4111 1111 1111 1111", "\n1.1.1.1\n\t2.2.2.2", "a.b.c.d@e.f-.g", None, "", " ", "@", "+", "a@", "1.1.1", "x" * 50 + "@y.de",
]


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randint(1, 60)) for _ in range(150)]
    for n in range(8):  # a name that stands with one address, and one that stands everywhere
        texts.append(f"{say(30)} Quillon {say(rng.randint(0, 9))} agent@desk.example.org {say(4)} Ubique {say(20)}")
        texts.append(f"{say(9)} Quorum {say(3)} +1 (017) 555-7713, {say(5)}")
    texts += [f"{say(5)} Ubique {say(3)}" for _ in range(40)] + [f"Quorum {say(4)}" for _ in range(5)]
    texts += [f"{say(20)} Quillon {say(2)}", f"Quillonix {say(3)}", f"Quillon@desk.example.org {say(3)}"]
    texts += [f"Herringbone {'x ' * 60}Farthing 10.9.8.7 {say(3)}"] * 40  # copies prove nothing
    return [(i, t) for i, t in enumerate(texts + ODD)] + [(3, texts[160]), (None, texts[161])]


@pytest.mark.parametrize(("support", "threshold", "reach"), [(3, 0.9, 100), (2, 0.5, 12), (5, 0.97, 40)])
def test_equals_plain_version(docs, support, threshold, reach):
    rows = corpus()
    expected, strong = plain(rows, support, threshold, reach)
    got = found(docs(rows), support=support, threshold=threshold, reach=reach).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    if (support, reach) == (3, 100):
        assert "Quillon" in strong and not {"Ubique", "Quorum", "Herringbone"} & strong


def test_reference_sql_on_planted_terms(docs):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    expected = con.execute(P.oracle_sql()).fetchall()
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, found(docs(rows)).collect()), key=order) == sorted(expected, key=order)


def test_sanitised_text_and_columns(docs):
    rows = corpus()
    got = {r.text: r for r in P.sanitise(docs(rows, clash=True)).collect()}
    assert all(r.slot == "x" and r.spans is not None for r in got.values())
    for r in got.values():
        if r.text and "Quillon " in r.text:
            assert "Quillon " not in r.sanitised and "agent@" not in r.sanitised
    assert got["+4111 1111 1111 1111"].sanitised == "+[CARD]"
    assert got["\n1.1.1.1\n\t2.2.2.2"].sanitised == "\n[IP]\n\t[IP]"
    assert got["@"].sanitised == "@" and got[None].sanitised == ""
    plain_text = next(r for r in got.values() if r.text and not r.spans and len(r.text) > 50)
    assert plain_text.sanitised == plain_text.text
    assert P.sanitise(docs([])).count() == 0


def test_long_texts_take_linear_time(docs):
    rows = [(1, "a" * 2_000_000), (2, "1" * 1_000_000), (3, "a." * 500_000), (4, "+1" + "(" * 1_000_000), (5, "0 " * 500_000), (6, "a@" * 400_000), (7, "1.1." * 20_000)]
    rows += [(8, " ".join(f"u{i}@h{i}.example" for i in range(20_000))), (9, "x@" + "a." * 200_000 + "b"), (10, "1." * 300_000)]
    began = time.time()
    got = {r.doc_id: r for r in found(docs(rows)).collect()}
    assert time.time() - began < 90
    assert got[8].n_email == 20_000 and got[9].n_email == 1 and got[7].n_ip == 10_000 and got[2].n_card == 0
    assert got[8].base_sha256 == plain([rows[7]], 3, 0.9, 100)[0][0][5]


def test_no_python_in_the_plan(docs):
    text = P.sanitise(docs(corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)
