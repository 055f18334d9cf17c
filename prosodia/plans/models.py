"""Model families that Spark lacks: a kernel machine by random cosine features, and extremely random trees."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(parts: DataFrame, length: int) -> np.ndarray:
    """Element-wise sum of (pid, sums binary of float64) rows, each of ``length`` numbers, in order of pid.

    Tasks' arrays are added 64 at a time before any come to the driver, in two levels.
    """

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("pid")
        total = np.zeros(length)
        for x in group["sums"]:
            total += np.frombuffer(x.as_buffer(), dtype=np.float64)
        return pa.table({"pid": group["pid"].slice(0, 1), "sums": [total.tobytes()]})

    once = parts
    for width in (64, 4096):
        once = once.withColumn("at", F.floor(F.col("pid") / width)).groupBy("at").applyInArrow(add, "pid int, sums binary")
    total = np.zeros(length)
    for r in sorted(once.collect(), key=lambda r: r.pid):  # a row for every 4,096 tasks
        total += np.frombuffer(r.sums, dtype=np.float64)
    return total


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class CosineFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Cosines whose inner products approach exp(-gamma * |x - y| ** 2).

    Directions are drawn from the kernel's spectrum and phases uniformly, from the seed alone, so only
    parameters are saved. gamma 0 stands for one over the number of features. The error of a product
    falls with the root of ``size``.
    """

    size = Param(Params._dummy(), "size", "number of cosines", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0: one over the number of features", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=512, gamma=0.0, seed=7):
        super().__init__()
        self._setDefault(size=512, gamma=0.0, seed=7)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def directions(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.getSeed())
        gamma = self.getOrDefault(self.gamma) or 1.0 / d
        return rng.normal(0.0, math.sqrt(2 * gamma), (d, self.getOrDefault(self.size))), rng.uniform(0.0, 2 * math.pi, self.getOrDefault(self.size))

    def _transform(self, df: DataFrame) -> DataFrame:
        own, size = self, self.getOrDefault(self.size)
        draw, known = own.directions, {}

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.stack(x.to_list())
            if m.shape[1] not in known:
                known[m.shape[1]] = draw(m.shape[1])
            w, b = known[m.shape[1]]
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(m @ w + b)))

        return df.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


class Forest:
    """Trees as parallel lists: feature (-1: a leaf), cut (at most: left), left, right, value (share of label 1)."""

    def __init__(self, trees: list[dict]):
        self.trees = trees

    def nodes(self, x: np.ndarray, t: int) -> np.ndarray:
        """The node that each row reaches in tree ``t``."""
        tree = self.trees[t]
        feature, cut, left, right = (np.array(tree[k]) for k in ("feature", "cut", "left", "right"))
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            i = rows[inner]
            here = at[i]
            at[i] = np.where(x[i, feature[here]] <= cut[here], left[here], right[here])

    def share(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t, tree in enumerate(self.trees):
            out += np.array(tree["value"])[self.nodes(x, t)]
        return out / max(1, len(self.trees))


def draw(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and cuts that a node tries: without repeats, each cut uniform between the node's bounds."""
    rng = np.random.default_rng([seed, tree, node])
    features = rng.choice(len(low), size=k, replace=False)
    return features, low[features] + rng.random(k) * (high[features] - low[features])


def gini(n0, n1):
    total = n0 + n1
    return total - (n0 * n0 + n1 * n1) / np.where(total > 0, total, 1.0)


class RandomCutTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """probability and prediction by the mean of the trees' leaves."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)
    importances = Param(Params._dummy(), "importances", "share of the gain by feature", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()

    def forest(self) -> Forest:
        return Forest(json.loads(self.getOrDefault(self.trees)))

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.forest().trees)

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            return pd.Series(Forest(shared.value).share(np.stack(x.to_list())) if len(x) else [], dtype=float)

        p = df.withColumn("__p", share(vector_to_array(self.getFeaturesCol())))
        return p.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")


class RandomCutTrees(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Extremely random trees for labels 0 and 1, grown level by level over the whole table.

    Each open node tries a share of the features with one cut each, uniform in the node's box (the table's
    least and greatest values, narrowed by the cuts above), and takes the one of greatest Gini gain that
    leaves ``leastLeaf`` rows on both sides. One pass a level sums the left side's weights of all tries
    of all trees; the sums' size depends on trees, depth and features alone. All rows grow every tree.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of cuts", TypeConverters.toInt)
    leastLeaf = Param(Params._dummy(), "leastLeaf", "least rows of a leaf", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of features tried at a node", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, numTrees=100, maxDepth=10, leastLeaf=2, share=0.8, seed=7):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=10, leastLeaf=2, share=0.8, seed=7)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def _fit(self, df: DataFrame) -> RandomCutTreesModel:
        get = self.getOrDefault
        weight = F.col(get(self.weightCol)) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = df.select(vector_to_array(get(self.featuresCol)).alias("x"), F.col(get(self.labelCol)).cast("double").alias("y"), weight.cast("double").alias("w"))
        bounds = {r.pos: (r.low, r.high) for r in rows.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).collect()}  # a row a feature
        d = len(bounds)
        low, high = (np.array([bounds[j][i] for j in range(d)]) for i in (0, 1))
        k, least, seed = max(1, math.ceil(get(self.share) * d)), get(self.leastLeaf), self.getSeed()
        trees = [{"feature": [-1], "cut": [0.0], "left": [0], "right": [0], "value": [0.5]} for _ in range(get(self.numTrees))]
        boxes = {(t, 0): (low, high) for t in range(len(trees))} if d else {}
        gain_of = np.zeros(d)
        for _ in range(get(self.maxDepth)):
            if not boxes:
                break
            tries = [(t, node, *draw(seed, t, node, *box, k)) for (t, node), box in sorted(boxes.items())]
            sums = self._sums(rows, trees, tries, k)
            boxes = self._grow(trees, boxes, tries, sums, least, gain_of)
        model = RandomCutTreesModel()
        model._set(featuresCol=get(self.featuresCol), trees=json.dumps(trees), importances=(gain_of / gain_of.sum() if gain_of.sum() else gain_of).tolist())
        return model

    @staticmethod
    def _sums(rows: DataFrame, trees: list[dict], tries: list[tuple], k: int) -> np.ndarray:
        """Per try: weight of label 0, of label 1 and rows of the node (first), then of the left side of each cut."""
        shared = rows.sparkSession.sparkContext.broadcast((trees, tries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own_trees, own_tries = shared.value
            forest, total = Forest(own_trees), np.zeros((len(own_tries), k + 1, 3))
            by_tree: dict[int, list[int]] = {}
            for i, (t, *_) in enumerate(own_tries):
                by_tree.setdefault(t, []).append(i)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, w = matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                each = np.stack([w * (y < 0.5), w * (y >= 0.5), np.ones(len(y))])
                for t, own in by_tree.items():
                    at = forest.nodes(x, t)
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], [own_tries[i][1] for i in own], side="right")
                    for i, begin, end in zip(own, np.searchsorted(at[order], [own_tries[i][1] for i in own]).tolist(), ends.tolist(), strict=True):
                        if begin == end:
                            continue
                        here = order[begin:end]
                        _, _, features, cuts = own_tries[i]
                        total[i, 0] += each[:, here].sum(axis=1)
                        total[i, 1:] += (each[:, here] @ (x[np.ix_(here, features)] <= cuts)).T
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["pid", "sums"])

        return added(rows.mapInArrow(run, "pid int, sums binary"), len(tries) * (k + 1) * 3).reshape(len(tries), k + 1, 3)

    @staticmethod
    def _grow(trees: list[dict], boxes: dict, tries: list[tuple], sums: np.ndarray, least: int, gain_of: np.ndarray) -> dict:
        """Cut each node at its best try; the boxes of the new nodes that are worth more."""
        left, whole = sums[:, 1:], sums[:, :1]
        right = whole - left
        gain = gini(whole[..., 0], whole[..., 1]) - gini(left[..., 0], left[..., 1]) - gini(right[..., 0], right[..., 1])
        gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least) & (gain > 1e-12), gain, -1.0)
        opened = {}
        for i, (t, node, features, cuts) in enumerate(tries):
            tree, (n0, n1, _) = trees[t], whole[i, 0]
            tree["value"][node] = float(n1 / (n0 + n1)) if n0 + n1 else 0.5
            j = int(gain[i].argmax())
            if gain[i, j] < 0:
                continue
            f, c = int(features[j]), float(cuts[j])
            gain_of[f] += gain[i, j]
            tree["feature"][node], tree["cut"][node] = f, c
            low, high = boxes[t, node]
            for side, (a, b, n) in (("left", left[i, j]), ("right", right[i, j])):
                child = len(tree["feature"])
                tree[side][node] = child
                for key, value in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("value", float(b / (a + b)) if a + b else 0.5)):
                    tree[key].append(value)
                if n >= 2 * least and a > 0 and b > 0:
                    lo, hi = low.copy(), high.copy()
                    (hi if side == "left" else lo)[f] = c
                    opened[t, child] = lo, hi
        return opened
