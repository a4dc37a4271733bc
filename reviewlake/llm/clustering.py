"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds over integer vectors, exact in every assignment. Each Arrow batch of vectors is one block, and a block
keeps one heap per cluster. A vector stands in the heap of its cluster under the gap between its distance to the second
nearest centroid and to its own, plus the drift its cluster had accumulated when the vector was last measured. When the
centroids move, a cluster's accumulated drift grows by its own move and the largest move of any other centroid: by the
triangle inequality a gap above the accumulated drift cannot have closed. So a round pops only the vectors whose gap has
expired, measures those against all centroids, and pushes them with their new gap.

Blocks are written to the shared folder after every round (components in one, two or four bytes, whatever the largest
needs) and never shuffled. A task sends one row of sums, of the vectors that moved only; the driver sees k * (size + 1)
totals and k centroids, numbers fixed by parameters. Equal vectors, however many, stay in their blocks.

Defined results: vectors that are null, of another size, or with a null, NaN or infinite component are left out (they have
no row); an empty table gives an empty result; fewer vectors than centroids give as many centroids as vectors. Seeds with
equal ids are ordered by their components; a null id counts as the empty text there. Repeated rows are vectors of their
own. A scaled component beyond 2**27 counts as 2**27, so that every distance fits in a long; inertia beyond a long counts
as the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import common as C

LIMIT = 1 << 27
LONGEST = (1 << 63) - 1
STATE = "ids array<bigint>, parts binary, width int, cluster binary, keys binary, slots binary, sizes array<int>, moved array<bigint>"
_STATE = pa.schema([
    ("ids", pa.list_(pa.int64())), ("parts", pa.binary()), ("width", pa.int32()), ("cluster", pa.binary()), ("keys", pa.binary()),
    ("slots", pa.binary()), ("sizes", pa.list_(pa.int32())), ("moved", pa.list_(pa.int64())),
])
ROWS = "vec_id bigint, cluster int, distance bigint"
_ROWS = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), held within the limit."""
    return np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; by floating-point products where all of them are whole numbers below 2**53."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * vectors.shape[1] * most * most < 1 << 53 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


class Block:
    """Vectors of one batch with their clusters and a heap of (gap plus drift, slot) for each cluster."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int):
        self.ids, self.vectors = ids, vectors
        self.cluster = np.full(len(vectors), -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    def measure(self, slots: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Assign the given slots exactly and push them; returns their clusters of before."""
        apart = distances(self.vectors[slots], centroids)
        nearest = apart.argmin(1).astype(np.int32)  # the first of equal ones
        own = apart[np.arange(len(slots)), nearest]
        apart[np.arange(len(slots)), nearest] = LONGEST
        second = np.sqrt(apart.min(1).astype(float))
        keys = second * (1 - 1e-9) - np.sqrt(own.astype(float)) - 1e-9 + drift[nearest]
        before = self.cluster[slots]
        self.cluster[slots] = nearest
        for key, slot, c in zip(keys.tolist(), slots.tolist(), nearest.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, slot))
        return before

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pop the slots whose gap the accumulated drift of their cluster has used up."""
        out = []
        for heap, gone in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= gone:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def row(self) -> tuple:
        most = int(np.abs(self.vectors).max(initial=0))
        width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
        flat = [x for heap in self.heaps for x in heap]
        return (
            self.ids.to_pylist(), self.vectors.astype(f"<i{width}").tobytes(), width, self.cluster.tobytes(),
            np.array([x[0] for x in flat], np.float64).tobytes(), np.array([x[1] for x in flat], np.int32).tobytes(),
            [len(heap) for heap in self.heaps], None,
        )

    @classmethod
    def of(cls, row: dict, k: int) -> Block:
        block = cls.__new__(cls)
        n = len(row["ids"])
        block.ids = pa.array(row["ids"], pa.int64())
        block.vectors = np.frombuffer(row["parts"], f"<i{row['width']}").astype(np.int64).reshape(n, -1)
        block.cluster = np.frombuffer(row["cluster"], np.int32).copy()
        keys, slots = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["slots"], np.int32).tolist()
        ends = np.cumsum([0, *row["sizes"]])
        block.heaps = [list(zip(keys[a:b], slots[a:b], strict=True)) for a, b in zip(ends, ends[1:], strict=False)]  # written as heaps
        return block


def _first(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, scale: float) -> Iterator[Block]:
    k, size = centroids.shape
    for batch in batches:
        if batch.num_rows:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, size)
            yield Block(batch.column(0), scaled(values, scale), k)


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                yield Block.of(row, k)


def _step(blocks: Iterator[Block], centroids: np.ndarray, drift: np.ndarray | None) -> Iterator[tuple[Block, np.ndarray]]:
    """Bring each block up to date; with it the k * size sums and k counts that its moved vectors changed."""
    k, size = centroids.shape
    for block in blocks:
        slots = np.arange(len(block.vectors)) if drift is None else block.expired(drift)
        change = np.zeros(k * (size + 1), np.int64)
        if len(slots):
            before = block.measure(slots, centroids, np.zeros(k) if drift is None else drift)
            sums, counts = change[: k * size].reshape(k, size), change[k * size :]
            went = before != block.cluster[slots]
            moved, left = slots[went], before[went]
            np.add.at(sums, block.cluster[moved], block.vectors[moved])
            np.add.at(counts, block.cluster[moved], 1)
            had = left >= 0
            np.subtract.at(sums, left[had], block.vectors[moved[had]])
            np.subtract.at(counts, left[had], 1)
        yield block, change


def assign_round(frame: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, scale: float) -> DataFrame:
    """Blocks after one assignment; a task's last row holds the changes of all its sums instead of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centroids.size + len(centroids), np.int64)
        blocks = _first(batches, centroids, scale) if drift is None else _blocks(batches, len(centroids))
        for block, change in _step(blocks, centroids, drift):
            total += change
            yield _batch([block.row()])
        yield _batch([(*[None] * 7, total.tolist())])

    return frame.mapInArrow(run, STATE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STATE)], schema=_STATE)


def _assigned(frame: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, scale: float) -> DataFrame:
    """The last assignment, a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _first(batches, centroids, scale) if drift is None else _blocks(batches, len(centroids))
        for block, _ in _step(blocks, centroids, drift):
            gap = block.vectors - centroids[block.cluster]
            yield pa.RecordBatch.from_arrays([block.ids.cast(pa.int64()), pa.array(block.cluster), pa.array((gap * gap).sum(1))], schema=_ROWS)

    return frame.mapInArrow(run, ROWS)


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a round adds to each cluster's accumulated drift: its own move and the largest one of the others."""
    gap = (new - old).astype(float)
    step = np.sqrt((gap * gap).sum(1)) * (1 + 1e-9)
    others = np.array([np.delete(step, c).max(initial=0) for c in range(len(step))])
    return step + others


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, seed: str = "1",
    id_column: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` rounds, and the final centroids."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        (F.size("v") == size) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = kept.orderBy(named, "v").limit(k).select("v").collect()
    if not seeds:
        return spark.createDataFrame([], ROWS), []
    centroids = scaled(np.array([r.v for r in seeds]), scale)
    sums = [0] * (centroids.size + len(centroids))
    frame, drift = kept, None
    for _ in range(rounds):
        frame = C.settled(assign_round(frame, centroids, drift, scale), "blocks")
        changes = frame.filter(F.col("moved").isNotNull()).select(F.posexplode("moved").alias("i", "x"))
        for r in changes.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            sums[r.i] += int(r.x)
        new = centroids.copy()
        for c in range(len(centroids)):
            if n := sums[centroids.size + c]:
                new[c] = [s // n for s in sums[c * size : (c + 1) * size]]
        drift = (np.zeros(len(centroids)) if drift is None else drift) + _moves(centroids, new)
        centroids = new
    return C.settled(_assigned(frame, centroids, drift, scale), "assigned"), centroids.tolist()


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Whole `embeddings`: 16 clusters, 3 rounds, components times 64."""
    rows, centroids = cluster(C.table(spark, folder, "embeddings").select("vec_id", "embedding"))
    inertia = {r.cluster: int(r.x) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    held = lambda x: F.lit(min(x, LONGEST)).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    return rows.withColumns({
        "cluster_inertia": of([held(inertia.get(c, 0)) for c in range(len(centroids))]).cast("long"),
        "inertia": held(sum(inertia.values())),
        "centroid_sha256": of([F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]).cast("string"),
    })


def oracle_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> str:
    """Plain rounds with every distance measured."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v
            FROM kept ORDER BY c LIMIT {k}
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT n, c, CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: (k.v[i] - t.v[i]) * (k.v[i] - t.v[i]))) AS BIGINT) AS d
                FROM kept k, c{r} t)
            GROUP BY n)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT t.c, CASE WHEN m.v IS NULL THEN t.v ELSE m.v END AS v FROM c{r} t LEFT JOIN (
                    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                        SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (n), range(1, {size + 1}) r(i) GROUP BY c, i)
                    GROUP BY c) m ON m.c = t.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(t.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (n) JOIN c{rounds} t ON t.c = a.c"""
