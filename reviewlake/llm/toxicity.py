"""Toxicity by maximum-scoring segments.

*Weights.* Units of a token are the word and its beginnings of 3 to 6 bytes (toxic stems take many endings). A unit is
counted in toxic and in other training texts by its distinct left neighbours, so near copies of one text count about
once. With a Dirichlet prior of ALPHA pseudo-counts split as the two classes are, its log-odds are those of a toxic
neighbour minus the classes' own. Units with at least LEAST toxic neighbours and log-odds of at least LEAST_ODDS form
the lexicon. A token scores the highest log-odds among its units; a token outside it, or the same word as the one
before, scores -DRIFT.

*Segments.* Every maximal scoring segment of a text is found by one scan in linear time; tokens without weight only add
their drift. Segment scores S are calibrated as extreme values: E = n exp(-lambda S) for n tokens, lambda from the
scores of clean training texts. Segments of E below 1 are the toxic passages; a text's evidence is the sum of their
-ln E, turned into a probability by a logistic curve fitted on training rows.

Labels are learned from a sample of SAMPLE training rows, or all if there are fewer: those whose hash is below SAMPLE / rows,
so no sort is needed and the number hardly varies. The lexicon and what the driver sees are bounded by it; texts of the
sample are never cut, and are written out once. Scoring is a map over all rows without shuffle.

Null and empty texts have no segment and the score of no evidence. Without labels of both classes no unit has weight and
every text scores the share of toxic rows, or 0. Labels of one id are joined by their maximum; null labels are ignored.
Equal texts score equally. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

SAMPLE = 20_000
ALPHA, LEAST, LEAST_ODDS, DRIFT = 5.0, 5, 2.0, 0.5
BEGINNINGS = (3, 4, 5, 6)
SHARDS = 16
CUT = 0.7
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def units(data: np.ndarray, offsets: np.ndarray):
    """Units of each token (a row per kind, 0 where a word is too short), its document, start and end."""
    data = _LOWER[data]
    starts, ends, doc = C.runs(_LETTER[data], offsets)
    marks = C.Rolling(data)
    rows = [marks.names(starts, ends)]
    for k in BEGINNINGS:
        rows.append(np.where(ends - starts > k, marks.names(starts, np.minimum(starts + k, ends)) ^ C.U64(k), C.U64(0)))
    return rows, doc, starts, ends


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score); `at` are the places of the tokens with positive scores.

    Each candidate keeps the running total before and after it. A new one joins back to the last candidate that began
    lower, if that one also ended lower; the list of candidates is linked by that test, so the scan is linear.
    """
    found: list[list] = []  # first, last, total before, total after, index of the last candidate that began lower
    total, last = 0.0, -1
    for place, gain in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (place - last - 1)
        new = [place, place, total, total + gain, -1]
        total, last = total + gain, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(first, end, after - before) for first, end, before, after, _ in found]


class Scorer:
    """Lexicon, calibration and curve; small and bounded by the sample."""

    def __init__(self, names: np.ndarray, weights: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights = names[order], weights[order]
        self.rate, self.intercept, self.slope = 1.0, -30.0, 0.0

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """Per document: tokens; places and scores of those with weight; starts and ends of all tokens."""
        rows, doc, starts, ends = units(data, offsets)
        best = np.zeros(len(doc))
        if len(self.names):
            for row in rows:
                j = np.minimum(np.searchsorted(self.names, row), len(self.names) - 1)
                np.maximum(best, np.where(self.names[j] == row, self.weights[j], 0.0), out=best)
            best[1:][(rows[0][1:] == rows[0][:-1]) & (doc[1:] == doc[:-1])] = 0.0
        return doc, best, starts, ends

    def evidence(self, n: int, at: np.ndarray, score: np.ndarray):
        """Sum of -ln E over the significant segments, and those segments."""
        kept = [(a, b, self.rate * s - math.log(max(n, 1))) for a, b, s in segments(at, score)]
        kept = [x for x in kept if x[2] > 0]
        return sum(x[2] for x in kept), kept

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def _documents(batches, scorer: Scorer, text: str = "text"):
    """Batch, and per document its evidence and its significant passages in characters."""
    for batch in C.slices(batches, text):
        data, offsets = C.byte_view(batch.column(batch.schema.get_field_index(text)))
        doc, best, starts, ends = scorer.hits(data, offsets)
        n = len(offsets) - 1
        first = np.searchsorted(doc, np.arange(n + 1))
        places = np.flatnonzero(best)
        cuts = np.searchsorted(places, first)
        evidence, passages = np.zeros(n), [[] for _ in range(n)]
        for j in np.unique(doc[places]).tolist():
            own = places[cuts[j] : cuts[j + 1]]
            evidence[j], kept = scorer.evidence(int(first[j + 1] - first[j]), own - first[j], best[own])
            body = data[offsets[j] : offsets[j + 1]]
            chars = np.append(0, np.cumsum((body & 0xC0) != 0x80)) if kept else None
            passages[j] = [{"start": int(chars[starts[first[j] + a] - offsets[j]]), "stop": int(chars[ends[first[j] + b] - offsets[j]]), "minus_ln_e": e} for a, b, e in kept]
        yield batch, np.diff(first), evidence, passages


def _roots(rate: float, pairs: list[tuple[float, float]]) -> float:
    return sum(p * math.exp(min(700.0, rate * s)) for s, p in pairs) - 1.0


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Scorer:
    """Lexicon from the sample's texts, then rate and curve from its scores. docs: doc_id, text; labels: doc_id, label."""
    chosen = labels.filter(F.col("label").isin(0, 1) & train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = C.settled(chosen, "labels")
    n = chosen.count()
    if n > sample:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    rows = C.settled(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "sample")  # about `sample` short rows

    def pairs(batches):
        """Distinct (unit, left neighbour) pairs of each class, by shard of the unit."""
        for batch in C.slices(batches):
            data, offsets = C.byte_view(batch.column(1))
            label = batch.column(2).to_numpy()
            kinds, doc, _, _ = units(data, offsets)
            left = np.full(len(doc), C.U64(1))
            left[1:] = np.where(doc[1:] == doc[:-1], kinds[0][:-1], C.U64(1))
            toxic = label[doc] == 1
            for side in (0, 1):
                pick = toxic == bool(side)
                unit = np.concatenate([k[pick] for k in kinds])
                both = np.concatenate([C.splitmix(k[pick] + C.splitmix(left[pick])) for k in kinds])
                keep = unit != 0
                unit, both = unit[keep], both[keep]
                _, at = np.unique(both, return_index=True)
                unit, both = unit[at], both[at]
                shard = (unit % C.U64(SHARDS)).astype(np.int64)
                for s in range(SHARDS):
                    here = shard == s
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([side], pa.int32()), pa.array([unit[here].tobytes()]), pa.array([both[here].tobytes()])], names=["shard", "side", "unit", "pair"])

    def counted(table: pa.Table) -> pa.Table:
        got = []
        for side in (0, 1):
            mine = table.filter(pa.array(table["side"].to_numpy() == side))
            unit, pair = (np.frombuffer(b"".join(mine[c].to_pylist()), C.U64) for c in ("unit", "pair"))
            _, at = np.unique(pair, return_index=True)
            got.append(np.unique(unit[at], return_counts=True))
        (clean, n_clean), (toxic, n_toxic) = got
        j = np.minimum(np.searchsorted(clean, toxic), max(len(clean) - 1, 0))
        other = np.where(clean[j] == toxic, n_clean[j], 0) if len(clean) else np.zeros(len(toxic), np.int64)
        often = n_toxic >= LEAST
        totals = [pa.array([0, 0]), pa.array([int(n_toxic.sum()), 0]), pa.array([0, int(n_clean.sum())])]
        names = ["unit", "toxic", "clean"]
        kept = pa.table([pa.array(toxic[often].astype(np.int64)), pa.array(n_toxic[often].astype(np.int64)), pa.array(other[often].astype(np.int64))], names=names)
        return pa.concat_tables([kept, pa.table(totals, names=names)])

    counts = C.settled(rows.mapInArrow(pairs, "shard int, side int, unit binary, pair binary").groupBy("shard").applyInArrow(counted, "unit long, toxic long, clean long"), "units")
    toxic, clean = counts.filter("unit = 0").agg(F.sum("toxic"), F.sum("clean")).first()
    none = Scorer(np.zeros(0, C.U64), np.zeros(0))
    n_toxic, n_rows = chosen.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not toxic or not clean:
        share = n_toxic / n_rows if n_rows else 0.0
        none.intercept = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return none
    base = toxic / (toxic + clean)
    odds = F.ln((F.col("toxic") + ALPHA * base) / (F.col("clean") + ALPHA * (1 - base))) - math.log(base / (1 - base))
    lexicon = counts.filter("unit <> 0").select("unit", odds.alias("weight")).filter(F.col("weight") >= LEAST_ODDS).toPandas()  # bounded by the sample
    scorer = Scorer(lexicon["unit"].to_numpy(np.int64).astype(C.U64), lexicon["weight"].to_numpy(float))

    def background(batches):
        for batch in C.slices(batches):
            data, offsets = C.byte_view(batch.column(1))
            clean_doc = batch.column(2).to_numpy() == 0
            doc, best, _, _ = scorer.hits(data, offsets)
            score, n = np.unique(np.round(best[clean_doc[doc]], 1), return_counts=True)
            yield pa.record_batch([pa.array(score), pa.array(n.astype(np.int64))], names=["score", "n"])

    seen = rows.mapInArrow(background, "score double, n long").groupBy("score").agg(F.sum("n")).collect()  # scores rounded to a tenth
    total = sum(n for _, n in seen) + 1.0
    top = float(scorer.weights.max()) if len(scorer.weights) else 1.0
    mix = [(s if s else -DRIFT, n / total) for s, n in seen] + [(top, 1.0 / total)]
    lo, hi = 0.0, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _roots(mid, mix) < 0 else (lo, mid)
    scorer.rate = lo

    def graded(batches):
        for batch, _, evidence, _ in _documents(batches, scorer):
            yield pa.record_batch([pa.array(np.round(np.log1p(evidence), 2)), batch.column(2)], names=["x", "label"])

    points = rows.mapInArrow(graded, "x double, label int").groupBy("x", "label").count().collect()  # evidence in hundredths of its log
    x, y, w = (np.array([r[i] for r in points], float) for i in range(3))
    scorer.intercept, scorer.slope = logistic(x, y, w)
    return scorer


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Weighted logistic curve by Newton steps with a small ridge."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, scorer: Scorer, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs` with toxic_score, toxic_segments and passages (start, stop in characters, minus_ln_e)."""
    docs = docs.drop("toxic_score", "toxic_segments", "toxic_passages")
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("minus_ln_e", pa.float64())]))

    def each(batches):
        for batch, _, evidence, passages in _documents(batches, scorer, text):
            yield pa.record_batch([*batch.columns, pa.array(scorer.probability(evidence)), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, kind)], names=[*names, "toxic_score", "toxic_segments", "toxic_passages"])

    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(each, f"{schema}, toxic_score double, toxic_segments int, toxic_passages array<struct<start:long,stop:long,minus_ln_e:double>>")


def labelled(spark: SparkSession, folder: str, column: str) -> DataFrame:
    return C.table(spark, folder, "labels").select("doc_id", F.col(column).alias("label"))


def held_out() -> Column:
    return C.in_part("doc_id", 3, 1)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents`; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs = C.table(spark, folder, "documents").select("doc_id", C.text_or_empty().alias("text"))
    scorer = fit(docs, labelled(spark, folder, "toxic"), ~held_out())
    scored = score(docs, scorer)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUT).cast("int").alias("predicted"), "toxic_segments"
    )
