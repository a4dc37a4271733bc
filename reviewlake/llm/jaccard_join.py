"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (lower-cased A-Z, split at white space; a shorter text is one shingle of all its
words). Texts of one set are one class, found by a 64-bit name of the set; everything below works on classes, so
thousands of copies cost one.

*Candidates.* BANDS bands of ROWS MinHash values; classes that agree in a band meet. A pair of similarity 0.8 misses all
of them with probability (1 - 0.8**3)**32 = 1e-10.
*Blocks.* Members of a band value are dealt to chunks of CHUNK; a task compares two chunks. A hot value is as many tasks
as it needs, a row goes to as many tasks as there are chunks, and pairs never become rows. A pair is looked at in the
first band that it shares, so it counts once.
*Pruning.* MinHash values are compared STEP at a time. With a uniform prior the similarity after m agreements of n is
Beta(1 + m, 1 + n - m); the pair is dropped when its chance of reaching the threshold is below TOLERANCE.
*Verification.* All others are verified exactly on their shingle sets, fetched once for classes that still have a partner.
Tasks return each class with the sum of its partners' copies and the least class it is connected to. Groups are the
connected components of links, by repeated least labels over that forest; nothing of it goes to the driver.

Result: doc_id, row (a hash of id and text), first_row (the group's least), class_id (least doc_id of its group), set_id (least doc_id of its class), n_links (other documents of
similarity 0.8 or more, copies included). Texts without words (null, empty, white space) have no links and are groups of
their own. Repeated rows count as copies. Rows with a null id take part; a group of only such rows has a null class_id.
Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 3
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-9
CHUNK, BUNDLE = 512, 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = C.splitmix(np.arange(1, HASHES + 1, dtype=C.U64) * C.U64(0xD1342543DE82EF95)) | C.U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each document and their document numbers, in order of document."""
    data = _LOWER[data]
    starts, ends, doc = C.word_spans(data, offsets)
    name = C.Rolling(data).names(starts, ends)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    found, owners = [], []
    for k in range(1, words + 1):
        if len(name) < k:
            break
        mixed = np.full(len(name) - k + 1, C.U64(k))
        for j in range(k):
            mixed = C.splitmix(mixed + name[j : len(name) - k + 1 + j])
        keep = doc[k - 1 :] == doc[: len(doc) - k + 1]
        if k < words:
            keep &= n[doc[: len(doc) - k + 1]] == k
        found.append(mixed[keep])
        owners.append(doc[: len(doc) - k + 1][keep])
    if not found:
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    name, doc = np.concatenate(found), np.concatenate(owners)
    _, at = np.unique(C.splitmix(name + C.splitmix(doc.astype(C.U64) + C.U64(1))), return_index=True)
    at = at[np.argsort(doc[at], kind="stable")]
    return name[at], doc[at]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), name of the set (null without words), n shingles, MinHash values as bytes."""

    def each(batches):
        for batch in C.slices(batches):
            data, offsets = C.byte_view(batch.column(1))
            name, doc = shingles(data, offsets)
            n = np.bincount(doc, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            first = np.searchsorted(doc, full)
            least = np.empty((len(full), HASHES), np.uint32)
            mixed = np.zeros(len(full), C.U64)
            if len(full):
                mixed = C.splitmix(np.add.reduceat(C.splitmix(name), first) + n[full].astype(C.U64))
                for h, seed in enumerate(_SEEDS):
                    least[:, h] = np.minimum.reduceat(((name * seed) >> C.U64(32)).astype(np.uint32), first)
            names = np.zeros(batch.num_rows, np.int64)
            names[full] = mixed.astype(np.int64)
            row = dict(zip(full.tolist(), range(len(full)), strict=True))
            yield pa.record_batch([
                batch.column(0), batch.column(2), pa.array(names, mask=n == 0), pa.array(n.astype(np.int32)), pa.array([least[row[j]].tobytes() if j in row else None for j in range(batch.num_rows)], pa.binary())
            ], names=["doc_id", "row", "name", "n", "least"])

    return docs.select("doc_id", "text", _row()).mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, name long, n int, least binary")


def _row():
    return F.xxhash64("doc_id", "text").alias("row")


def needed_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Least agreements among the first n values with which a pair stays, for n = STEP, 2 STEP, ..."""
    s = (np.arange(4000) + 0.5) / 4000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                out[n] = m
                break
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    """Band values of each row of MinHash values."""
    out = np.empty((len(least), BANDS), C.U64)
    for b in range(BANDS):
        value = np.full(len(least), C.U64(b + 1))
        for r in range(ROWS):
            value = C.splitmix(value + least[:, b * ROWS + r])
        out[:, b] = value
    return out


def _keys(classes: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            if batch.num_rows:
                least = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
                yield pa.record_batch([
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(least))), pa.array(_bands(least).ravel().astype(np.int64))
                ], names=["name", "band", "key"])

    return classes.select("name", "least").mapInArrow(each, "name long, band int, key long")


def _tasks(keys: DataFrame, chunk: int) -> DataFrame:
    """(bundle, key, band, i, j, name, own): members of band values that several classes share, dealt to pairs of chunks.

    Pairs of chunks are bundled, so that a task has about BUNDLE rows however many small values there are.
    """
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int"))
    many = C.settled(many, "shared_bands")
    rows = many.agg(F.sum(F.col("members") * F.col("chunks"))).first()[0] or 0
    met = keys.join(many, "key").withColumn("own", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int"))
    pairs = met.select("key", "band", "name", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name", "own"
    )
    return pairs.withColumn("bundle", F.pmod(F.xxhash64("key", "i", "j"), F.lit(rows // BUNDLE + 1)).cast("int"))


def _blocks(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """First rows of the runs of one (key, i, j), and the number of rows."""
    new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])


def candidates(least: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray, band: np.ndarray, needed: dict[int, int]):
    """Pairs of rows to verify and their block, for rows in order of (key, i, j): of chunks i and j, first meeting in this
    band, not pruned."""
    cuts = _blocks(key, i, j)
    sizes = np.diff(cuts)
    left, right = [], []
    same = i[cuts[:-1]] == j[cuts[:-1]]
    for m in np.unique(sizes[same]):
        x, y = np.triu_indices(m, 1)
        first = cuts[:-1][same & (sizes == m)][:, None]
        left.append((first + x).ravel())
        right.append((first + y).ravel())
    for at, n in zip(cuts[:-1][~same].tolist(), sizes[~same].tolist(), strict=True):
        x, y = (at + np.flatnonzero(own[at : at + n] == side) for side in (i[at], j[at]))
        left.append(np.repeat(x, len(y)))
        right.append(np.tile(y, len(x)))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    agree = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        agree += (least[a, at : at + STEP] == least[b, at : at + STEP]).sum(1)
        keep = agree >= needed[at + STEP]
        a, b, agree = a[keep], b[keep], agree[keep]
    value = _bands(least)
    met = band[a]
    keep = np.ones(len(a), bool)
    for earlier in range(BANDS):
        keep &= (earlier >= met) | (value[a, earlier] != value[b, earlier])
    a, b = a[keep], b[keep]
    return a, b, np.searchsorted(cuts, a, "right") - 1


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact number of shingles that each pair of sets shares, by products of the sets' membership matrix."""
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1, width):  # counts stay below 2**24, where float32 is exact
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    return both[a, b].astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component under the given pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(tasks: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(name, root, n): per task and class with a link, the least class of its part of the group and its partners' copies."""
    needed = needed_matches(threshold, TOLERANCE)

    def opened(table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in ("key", "i", "j", "name")])
        least = np.frombuffer(b"".join(table["least"].to_pylist()), np.uint32).reshape(-1, HASHES)
        return table, candidates(least, *[table[c].to_numpy() for c in ("key", "i", "j", "own", "band")], needed)

    def prune(table: pa.Table) -> pa.Table:
        table, (a, b, _) = opened(table)
        keep = np.zeros(table.num_rows, bool)
        keep[a] = keep[b] = True
        return table.filter(pa.array(keep))

    full = tasks.join(classes.select("name", "least", "n", "copies"), "name").select("bundle", "key", "band", "i", "j", "name", "own", "least", "n", "copies")
    kinds = "bundle int, key long, band int, i int, j int, name long, own int, least binary, n int, copies long"
    left = C.settled(full.groupBy("bundle").applyInArrow(prune, kinds), "candidates")

    def sets(batches):
        for batch in C.slices(batches):
            name, doc = shingles(*C.byte_view(batch.column(1)))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column(0), pa.array([np.sort(name[x:y]).tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())], names=["name", "shingles"])

    asked = classes.join(left.select("name").distinct(), "name").select("name", "row")
    # One text of each class that still has a partner. Repeated rows are the same row here; any of them will do.
    speakers = docs.select(_row(), "text").join(asked, "row").select("name", "text").mapInArrow(sets, "name long, shingles binary")
    speakers = speakers.groupBy("name").agg(F.first("shingles").alias("shingles"))

    def verify(table: pa.Table) -> pa.Table:
        table, (a, b, block) = opened(table)
        names = table["name"].to_numpy()
        own = [np.frombuffer(x, C.U64) for x in table["shingles"].to_pylist()]
        size, copies = np.array([len(x) for x in own], np.int64), table["copies"].to_numpy()
        both = np.zeros(len(a), np.int64)
        pairs = np.bincount(block)
        heavy = pairs > 256
        for x in np.flatnonzero(~heavy[block] if len(a) else []).tolist():
            both[x] = len(np.intersect1d(own[a[x]], own[b[x]], assume_unique=True))
        for k in np.flatnonzero(heavy).tolist():
            mine = np.flatnonzero(block == k)
            rows, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
            both[mine] = shared([own[r] for r in rows], at[: len(mine)], at[len(mine) :])
        ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
        a, b = a[ok], b[ok]
        n = np.bincount(a, copies[b], len(own)) + np.bincount(b, copies[a], len(own))
        root = _roots(len(own), a, b)
        linked = np.flatnonzero(n)
        return pa.table([pa.array(names[linked]), pa.array(names[root[linked]]), pa.array(n[linked].astype(np.int64))], names=["name", "root", "n"])

    whole = left.join(speakers, "name")
    return whole.groupBy("bundle").applyInArrow(verify, "name long, root long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(name, label): the least name of each name's component; edges: (name, root). Labels are written out each round."""
    both = edges.filter("name <> root").select("name", "root").union(edges.filter("name <> root").select(F.col("root").alias("name"), F.col("name").alias("root")))
    both = C.settled(both.distinct(), "edges")
    labels = C.settled(both.groupBy("name").agg(F.least(F.col("name"), F.min("root")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("name").alias("root"), "label"), "root").groupBy("name").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "name").select("name", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("name").alias("next"), F.col("label").alias("jump"))
        new = C.settled(stepped.join(jump, "next").select("name", "label", F.least("next", "jump").alias("next")), "labels")
        if new.filter("label <> next").isEmpty():
            return labels
        labels = new.select("name", F.col("next").alias("label"))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, set_id, n_links, row, first_row of every document."""
    docs = docs.select(F.col(id_column).alias("doc_id"), C.text_or_empty(text).alias("text"))
    signed = C.settled(signatures(docs), "signatures")
    classes = signed.filter("name IS NOT NULL").groupBy("name").agg(
        F.first("least").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("head")
    ).select("name", "least", "n", "copies", "head", F.col("head.row").alias("row"))
    classes = C.settled(classes, "classes")
    found = C.settled(links(_tasks(_keys(classes), chunk), classes, docs, threshold), "links")
    labels = components(found)
    per_class = classes.select("name", "copies", "head").join(found.groupBy("name").agg(F.sum("n").alias("others")), "name", "left").join(labels, "name", "left")
    per_class = per_class.select("name", "head", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "name").alias("label"))
    heads = per_class.groupBy("label").agg(F.min("head").alias("first"))
    whole = per_class.join(heads, "label").select("name", "first", "head", "n_links")
    joined = signed.select("doc_id", "row", "name").join(whole, "name", "left")
    own = lambda group, column: F.when(F.col("name").isNull(), F.col(column)).otherwise(F.col(f"{group}.{column}"))
    return joined.select(
        "doc_id", own("first", "doc_id").alias("class_id"), own("head", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "row", own("first", "row").alias("first_row"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one of each group: the least id (ids before nulls); of repeated rows one."""
    mark = F.xxhash64(F.col(id_column), C.text_or_empty(text))
    kept = jaccard_join(docs, id_column, text).filter("row = first_row").select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", mark).join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `documents`: five words, similarity 0.8."""
    return jaccard_join(C.table(spark, folder, "documents")).drop("row", "first_row")
