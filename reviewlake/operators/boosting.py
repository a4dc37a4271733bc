"""Gradient boosting of one softmax over all classes: a round adds one tree per class, fitted to the probabilities that all share.

Tree k of a round is fitted to weight * ([y = k] - p_k), the falling gradient of the log loss. A split is the one of the largest
gain in squared error; a leaf's value is (K - 1) / K * sum of gradients / sum of weight * p * (1 - p), one Newton step, times stepSize.

Features are sparse and not negative. Their values are sorted into BINS evenly spaced bins between the feature's smallest and largest
one that is not zero; zero comes before all. A split says which bins go right.

Rows are packed into blocks. A level of all trees of a round is one pass: blocks sum gradients by (class, node, feature, bin),
touched ones only, a task adds up those of its blocks, and features are dealt to at most SHARDS tasks that add them up and pick their best split of each node; the
driver gets that and the node's total from each task, however many rows, blocks or features there are. Scores of rows are kept with the blocks, written out every RENEW rounds to the shared folder, and brought up
to date by the trees since then, so neither lineage nor memory grows with the rounds and a lost executor repeats little.

`losses` of a model are the mean log losses before each round and after the last. Rows with a null label, weight or features are left
out; with none left, or with a negative value, the fit raises ValueError. A class without rows gets its small prior.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasSeed,
    HasStepSize,
    HasWeightCol,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.squared_hinge import packed
from reviewlake.session import settled, ship_package

BINS, RENEW, SHARDS = 16, 25, 16
DENSE = 1 << 22  # cells that a task adds up in an array, 128 MB; beyond that by sorted keys
SCORED = 1 << 10  # rows scored at once
LEAST_PRIOR, LEAST_CURVE, LEAST_GAIN = 1e-6, 1e-12, 1e-9


def bins_of(value: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bins 1 .. BINS of values that are not zero, 0 of zeros; `low` and `width` are those of their features."""
    inside = np.clip(((value - low) / width).astype(np.int64), 0, BINS - 1) + 1
    return np.where(value == 0, 0, inside)


class Tree:
    """Splits and leaves by node; node j has the children 2j + 1 and 2j + 2, the latter for bins from the split's on."""

    def __init__(self):
        self.splits: dict[int, tuple[int, int]] = {}
        self.leaves: dict[int, float] = {}

    def nodes(self, n: int, right) -> np.ndarray:
        """The node that each of n rows has reached; `right(feature, bin)` marks the rows that go right."""
        node = np.zeros(n, np.int64)
        for j in sorted(self.splits):
            here = node == j
            if here.any():
                node[here] = 2 * j + 1 + right(*self.splits[j])[here]
        return node

    def values(self, node: np.ndarray) -> np.ndarray:
        table = np.zeros(max([*self.leaves, int(node.max(initial=0))]) + 1)
        table[list(self.leaves)] = list(self.leaves.values())
        return table[node]


class Rows:
    """A block: entries by feature, labels, weights, scores of all classes."""

    def __init__(self, block, low: np.ndarray, width: np.ndarray, scores: np.ndarray, number: int):
        bins = bins_of(block.value, low[block.column], width[block.column])
        order = np.flatnonzero(bins)
        order = order[np.argsort(block.column[order], kind="stable")]
        self.row, self.column, self.bin = block.row[order].astype(np.int32), block.column[order].astype(np.int32), bins[order].astype(np.int8)
        cells, of = np.unique(self.column.astype(np.int64) * (BINS + 1) + self.bin, return_inverse=True)
        self.cells, self.cell = cells, of.astype(np.int32)
        self.label, self.weight, self.number = block.label, block.weight, number
        self.scores = np.tile(scores, (len(self.label), 1))

    def right(self, feature: int, least: int) -> np.ndarray:
        a, b = np.searchsorted(self.column, [feature, feature + 1])
        out = np.zeros(len(self.label), np.int64)
        out[self.row[a:b][self.bin[a:b] >= least]] = 1
        return out

    def advanced(self, rounds: list[list[Tree]]) -> np.ndarray:
        """Scores after the rounds."""
        scores = self.scores.copy()
        for trees in rounds:
            for k, tree in enumerate(trees):
                scores[:, k] += tree.values(tree.nodes(len(scores), self.right))
        return scores

    def loss(self, rounds: list[list[Tree]]) -> tuple[float, float]:
        p = softmax(self.advanced(rounds))
        return float((-self.weight * np.log(np.maximum(p[np.arange(len(p)), self.label], 1e-300))).sum()), float(self.weight.sum())

    def sums(self, rounds: list[list[Tree]], growing: list[Tree], level: int, features: int, draw: tuple[int, int, float]):
        """Of nodes of a level: keys ((class * nodes + node) * features + feature) * (BINS + 1) + bin, and gradient, curve, weight and rows of each.

        The feature `features` stands for the whole node. Nodes that cannot grow any more are left out.
        """
        scores = self.advanced(rounds)
        p = softmax(scores)
        n, classes = scores.shape
        live = np.ones(n, bool)
        seed, number, share = draw
        if share < 1.0:
            live = np.random.Generator(np.random.Philox(key=[seed, (number << 32) + self.number])).random(n) < share
        first, nodes = (1 << level) - 1, 1 << level
        # Cells of a node: those that entries touch, then the node itself.
        cells = np.append(self.cells, features * (BINS + 1))
        cell, row = np.append(self.cell, np.full(n, len(cells) - 1)), np.append(self.row, np.arange(n))
        keys, sums = [], []
        for k, tree in enumerate(growing):
            node = tree.nodes(n, self.right) - first
            node[~live] = -1
            of = node[row]
            at = slice(None) if node.min(initial=0) >= 0 else np.flatnonzero(of >= 0)
            place, rows = of[at] * len(cells) + cell[at], row[at]
            curve = self.weight * p[:, k] * (1 - p[:, k])
            size = nodes * len(cells)
            many = np.bincount(place, minlength=size)
            some = np.flatnonzero(many)
            values = [np.bincount(place, x[rows], size)[some] for x in (self.weight * ((self.label == k) - p[:, k]), curve, self.weight)]
            keys.append((k * nodes + some // len(cells)) * ((features + 1) * (BINS + 1)) + cells[some % len(cells)])
            sums.append(np.stack([*values, many[some]], 1))
        return np.concatenate(keys), np.concatenate(sums)


def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(of, sums[:, c], len(distinct)) for c in range(sums.shape[1])], 1)


def added_up(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """`added` over parts of distinct keys below `size`, holding no more than the cells and a few parts."""
    if size <= DENSE:
        total = np.zeros((size, 4))
        for keys, sums in parts:
            total[keys] += sums
        keys = np.flatnonzero(total[:, 3])
        return keys, total[keys]
    keys, sums = np.zeros(0, np.int64), np.zeros((0, 4))
    for more in parts:
        keys, sums = added(np.append(keys, more[0]), np.append(sums, more[1], 0))
    return keys, sums


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def choose(keys: np.ndarray, sums: np.ndarray, features: int, nodes: int, least_rows: int) -> Iterator[tuple]:
    """(class, node, sums of the node, best split or None): a split is (feature, bin, gain, sums of its right side)."""
    cell, bins = keys // (BINS + 1), keys % (BINS + 1)
    group, feature = cell // (features + 1), cell % (features + 1)
    whole = feature == features
    place = np.searchsorted(group[whole], group)
    total = sums[whole][place]
    last = np.append(cell[1:] != cell[:-1], True)
    back = np.cumsum(sums[::-1], 0)[::-1]  # sums from each key to the end
    after = np.append(back[1:], np.zeros((1, sums.shape[1])), 0)[np.flatnonzero(last)[np.cumsum(np.append(0, last[:-1]))]]
    right = back - after
    left = total - right
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = right[:, 0] ** 2 / right[:, 2] + left[:, 0] ** 2 / left[:, 2] - total[:, 0] ** 2 / total[:, 2]
    able = ~whole & (np.round(right[:, 3]) >= least_rows) & (np.round(left[:, 3]) >= least_rows) & (gain > LEAST_GAIN)
    gain = np.where(able, np.round(gain, 9), -1.0)
    best = np.lexsort((keys, -gain, group))
    for j in best[np.append(True, group[best][1:] != group[best][:-1])].tolist():
        split = (int(feature[j]), int(bins[j]), float(gain[j]), right[j]) if able[j] else None
        yield int(group[j]) // nodes, int(group[j]) % nodes, total[j], split


def best_splits(state, sent, features: int, nodes: int, least_rows: int, shards: int) -> Iterator[tuple]:
    """As `choose` over the sums of all blocks. Each shard of the features has the sums of whole nodes too."""

    def dealt(blocks):
        growing = sent.value[1]
        keys, sums = added_up((b.sums(*sent.value) for b in blocks), len(growing) * nodes * (features + 1) * (BINS + 1))
        feature = keys // (BINS + 1) % (features + 1)
        for s in range(shards):
            at = (feature == features) | (feature % shards == s)
            yield s, (keys[at], sums[at])

    merged = state.mapPartitions(dealt).reduceByKey(lambda a, b: added(np.append(a[0], b[0]), np.append(a[1], b[1], 0)), shards)
    found = merged.map(lambda x: (x[0], list(choose(*x[1], features, nodes, least_rows)))).collect()  # one row for each shard, class and node
    best = {}
    for _, rows in sorted(found, key=lambda x: x[0]):
        for k, node, total, split in rows:
            total, old = best.get((k, node), (total, None))
            better = split and (old is None or (-split[2], split[:2]) < (-old[2], old[:2]))
            best[k, node] = total, split if better else old
    for (k, node), (total, split) in sorted(best.items(), key=lambda x: x[0]):
        yield k, node, total, split


class _Settings(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth: Param[int] = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    minInstancesPerNode: Param[int] = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    subsamplingRate: Param[float] = Param(Params._dummy(), "subsamplingRate", "share of rows that fit a round", TypeConverters.toFloat)


class JointBoosting(Estimator, _Settings):
    """Estimator of `JointBoostingModel`; labels are 0, 1, ... as doubles."""

    @keyword_only
    def __init__(self, *, maxIter: int | None = None, maxDepth: int | None = None, stepSize: float | None = None, minInstancesPerNode: int | None = None,
                 subsamplingRate: float | None = None, seed: int | None = None, weightCol: str | None = None, featuresCol: str | None = None,
                 labelCol: str | None = None, predictionCol: str | None = None, rawPredictionCol: str | None = None, probabilityCol: str | None = None):
        super().__init__()
        self._setDefault(maxIter=150, maxDepth=3, stepSize=0.1, minInstancesPerNode=1, subsamplingRate=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> JointBoostingModel:
        spark = dataset.sparkSession
        ship_package(spark)
        weight = F.col(self.getWeightCol()) if self.isSet("weightCol") else F.lit(1.0)
        rows = dataset.select(F.col(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"), weight.cast("double").alias("s")).dropna()
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        features, step = first.x.size, self.getStepSize()
        blocks = rows.rdd.mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK)

        def measured(block):
            """Smallest and largest value of each feature, and the weight of each class."""
            low, high = np.full(features, np.inf), np.zeros(features)
            some = block.value != 0
            np.minimum.at(low, block.column[some], block.value[some])
            np.maximum.at(high, block.column[some], block.value[some])
            if block.value.min(initial=0.0) < 0:
                low[0] = -1.0
            return low, high, np.bincount(block.label, block.weight)

        def wider(a, b):
            n = np.zeros(max(len(a[2]), len(b[2])))
            n[: len(a[2])] += a[2]
            n[: len(b[2])] += b[2]
            return np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), n

        low, high, prior = blocks.map(measured).treeReduce(wider)
        if (low < 0).any():
            raise ValueError("features must not be negative")
        low = np.where(np.isfinite(low), low, 0.0)
        width = np.where(high > low, (high - low) / BINS, 1.0)
        start = np.log(np.maximum(prior / prior.sum(), LEAST_PRIOR))
        classes = len(start)

        def begun(number, mine):
            for j, block in enumerate(mine):
                yield (pickle.dumps(Rows(block, low, width, start, (number << 16) + j)),)

        def written(rdd):
            return settled(spark.createDataFrame(rdd, "block binary"), "boosting").rdd.map(lambda r: pickle.loads(bytes(r.block))).persist(StorageLevel.MEMORY_AND_DISK)

        state = written(blocks.mapPartitionsWithIndex(begun))
        blocks.unpersist()
        done, since, losses = [], [], []
        gains = np.zeros(features)

        def loss(state, since):
            a, b = state.map(lambda x: x.loss(since)).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
            return a / b

        for number in range(self.getMaxIter()):
            if number % RENEW == 0:
                losses.append((number, loss(state, since)))
            trees = self._round(state, since, features, classes, number, gains)
            for tree in trees:
                tree.leaves = {j: step * (classes - 1) / classes * x for j, x in tree.leaves.items()}
            done.append(trees)
            since = [*since, trees]
            if len(since) == RENEW and number + 1 < self.getMaxIter():
                old, state = state, written(state.map(lambda x, since=since: (pickle.dumps(_moved(x, since)),)))
                state.count()
                old.unpersist()
                since = []
        losses.append((self.getMaxIter(), loss(state, since)))
        state.unpersist()
        model = JointBoostingModel(done, start, low, width, losses, gains)
        self._copyValues(model)
        return model

    def _round(self, state, since, features: int, classes: int, number: int, gains: np.ndarray) -> list[Tree]:
        """One tree per class; leaves are not yet scaled."""
        trees = [Tree() for _ in range(classes)]
        draw = (self.getSeed(), number, self.getOrDefault("subsamplingRate"))
        for level in range(self.getOrDefault("maxDepth")):
            nodes, offset = 1 << level, (1 << level) - 1
            if level and not any(j >= offset // 2 for t in trees for j in t.splits):
                break
            sent = state.context.broadcast((since, trees, level, features, draw))  # at most RENEW rounds of small trees
            shards = max(1, min(SHARDS, state.getNumPartitions()))
            found = list(best_splits(state, sent, features, nodes, self.getOrDefault("minInstancesPerNode"), shards))
            sent.destroy()
            for k, node, total, split in found:
                j = offset + node
                trees[k].leaves[j] = total[0] / max(total[1], LEAST_CURVE)
                if split:
                    feature, least, gain, right = split
                    trees[k].splits[j] = (feature, least)
                    del trees[k].leaves[j]
                    for child, part in ((2 * j + 1, total - right), (2 * j + 2, right)):
                        trees[k].leaves[child] = part[0] / max(part[1], LEAST_CURVE)
                    gains[feature] += gain
        return trees


def _moved(rows: Rows, rounds: list[list[Tree]]) -> Rows:
    rows.scores = rows.advanced(rounds)
    return rows


class JointBoostingModel(Model, _Settings):
    """Rounds of trees; adds rawPrediction, probability and prediction in Arrow batches over the features that trees use."""

    def __init__(self, rounds: list[list[Tree]], start: np.ndarray, low: np.ndarray, width: np.ndarray, losses: list[tuple[int, float]], gains: np.ndarray):
        super().__init__()
        self.rounds, self.start, self.low, self.width, self.losses = rounds, start, low, width, losses
        self.featureImportances = Vectors.dense(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        used = sorted({f for trees in self.rounds for t in trees for f, _ in t.splits.values()}) or [0]
        place, rounds, start, low, width = {f: i for i, f in enumerate(used)}, self.rounds, self.start, self.low[used], self.width[used]

        @F.pandas_udf("array<double>")
        def scored(x: pd.Series) -> pd.Series:
            out = []
            for a in range(0, len(x), SCORED):
                bins = bins_of(np.stack(x.iloc[a : a + SCORED].to_numpy()), low, width).astype(np.int8)
                scores = np.tile(start, (len(bins), 1))
                for trees in rounds:
                    for k, tree in enumerate(trees):
                        scores[:, k] += tree.values(tree.nodes(len(bins), lambda f, least, bins=bins: (bins[:, place[f]] >= least).astype(np.int64)))
                out += list(scores)
            return pd.Series(out, dtype=object)

        sliced = VectorSlicer(inputCol=self.getFeaturesCol(), outputCol="__used", indices=used).transform(dataset)
        raw = sliced.withColumn("__raw", scored(vector_to_array("__used"))).drop("__used")
        raw = raw.withColumn("__e", F.transform("__raw", lambda s: F.exp(s - F.array_max("__raw"))))
        share = F.transform("__e", lambda e: e / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
        return raw.withColumns({
            self.getRawPredictionCol(): array_to_vector("__raw"), self.getProbabilityCol(): array_to_vector(share),
            self.getPredictionCol(): (F.array_position("__raw", F.array_max("__raw")) - 1).cast("double"),
        }).drop("__raw", "__e")
