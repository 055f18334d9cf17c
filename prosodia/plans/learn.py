"""Training and choice of event detectors: models, thresholds, nested leave-one-recording-out.

The kernel machine is a linear one on random cosine features, the extremely random trees are this library's
(``plans/models.py``); linear detectors are left out recording by recording from sums (``plans/folds.py``).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.operators import events, ordered
from prosodia.plans.models import CosineFeatures, RandomCutTrees

VERSION = 1

#: What the kernel machine pays for a row inside the margin, against half the squared norm.
COST = 1.5

#: Of each family its stages on the ``scaled`` features, for so many training rows.
FACTORIES = {
    "logistic": lambda n: [LogisticRegression(maxIter=100, regParam=0.01, weightCol="weight", featuresCol="scaled")],
    "linear_svm": lambda n: [LinearSVC(maxIter=100, regParam=0.01, weightCol="weight", featuresCol="scaled")],
    "kernel_svm": lambda n: [
        CosineFeatures(inputCol="scaled", outputCol="cosines", size=512, seed=7),
        LinearSVC(maxIter=100, regParam=1 / (COST * max(n, 1)), weightCol="weight", featuresCol="cosines", standardization=False),
    ],
    "forest": lambda n: [RandomForestClassifier(numTrees=100, maxDepth=8, seed=7, weightCol="weight", featuresCol="scaled")],
    "random_cuts": lambda n: [RandomCutTrees(featuresCol="scaled", weightCol="weight", numTrees=100, maxDepth=10, leastLeaf=2, share=0.8, seed=23)],
    "boosted": lambda n: [GBTClassifier(maxIter=40, maxDepth=4, seed=7, weightCol="weight", featuresCol="scaled")],
}


def balanced(df: DataFrame) -> DataFrame:
    """A weight that gives both labels half of the total."""
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # two labels
    each = sum(n.values()) / max(1, len(n))
    weight = F.lit(1.0)
    for label, count in n.items():
        weight = F.when(F.col("label") == F.lit(label), F.lit(each / count)).otherwise(weight)
    return df.withColumn("weight", weight)


def fit(df: DataFrame, kind: str = "boosted") -> PipelineModel:
    """features, label -> a scaled model."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    n = df.count() if kind == "kernel_svm" else 0
    return Pipeline(stages=[scaler, *FACTORIES[kind](n)]).fit(balanced(df))


def scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add score: the margin where the model has no probability, else P(1)."""
    out = model.transform(df)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(column)[1]).drop("rawPrediction", "probability", "prediction", "scaled", "cosines")


def _united(scores: list[float], times: list[float], base: list[float], reference: list[float], thresholds: list[float], distances: list[float], tolerance: float) -> np.ndarray:
    """Kept events and pairs of one run: all of ``base``, and in order of time what stands apart from all kept."""
    out = np.zeros((len(distances), len(thresholds), 2), dtype=np.int64)
    order = sorted(range(len(times)), key=lambda i: times[i])
    for a, distance in enumerate(distances):
        for k, threshold in enumerate(thresholds):
            kept = sorted(base)
            for j in order:
                if scores[j] >= threshold:
                    t = times[j]
                    i = bisect_left(kept, t)
                    if (i == 0 or t - kept[i - 1] >= distance) and (i == len(kept) or kept[i] - t >= distance):
                        kept.insert(i, t)
            out[a, k] = len(kept), events.match_count(kept, reference, tolerance)
    return out


def _swept(scores: list[float], ids: list[int], times: list[float], reference: list[float], thresholds: list[float], distances: list[float], tolerance: float) -> np.ndarray:
    """Kept events and pairs of one run (distances x thresholds x 2).

    Events are tried once per distance, by falling score (ties: earlier id): what is kept above a threshold
    doesn't depend on what lies below it. Pairs are counted again only where a threshold adds a kept event.
    """
    out = np.zeros((len(distances), len(thresholds), 2), dtype=np.int64)
    falling = sorted(range(len(thresholds)), key=lambda k: -thresholds[k])
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))
    for a, distance in enumerate(distances):
        kept: list[float] = []
        at, pairs, counted = 0, 0, 0
        for k in falling:
            while at < len(order) and scores[order[at]] >= thresholds[k]:
                t = times[order[at]]
                i = bisect_left(kept, t)
                if (i == 0 or t - kept[i - 1] >= distance) and (i == len(kept) or kept[i] - t >= distance):
                    kept.insert(i, t)
                at += 1
            if len(kept) > counted:
                counted, pairs = len(kept), events.match_count(kept, reference, tolerance)
            out[a, k] = counted, pairs
    return out


def sweep(scored: DataFrame, reference: DataFrame, thresholds: list[float], distances: list[float], tolerance: float = 0.050, base: DataFrame | None = None) -> DataFrame:
    """recording_id, grid_idx, threshold, distance, tp, fp, fn of every threshold and distance per recording, thinned greedily by score.

    With ``base`` (recording_id, t) its events all stay and scored ones join in order of time where they stand apart.

    scored: recording_id, event_id, t, score; events without a score or time are left out. Each event travels
    once, whatever the grid: recordings are cut where neither suppression nor matching reaches across (gaps over the
    largest distance and the tolerance), and one pass over a run by falling score counts every setting.
    """
    own = scored.filter("t is not null and score is not null").select("recording_id", F.col("t").cast("double").alias("t"), F.lit(0).alias("side"), F.col("event_id").cast("long").alias("id"), F.col("score").cast("double").alias("score"))
    truth = reference.filter("t is not null").select("recording_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"))
    both = own.unionByName(truth)
    if base is not None:
        both = both.unionByName(base.filter("t is not null").select("recording_id", F.col("t").cast("double").alias("t"), F.lit(2).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score")))
    cut = ordered.gap_runs(both, "recording_id", "t", ["t", "side", "id"], max([tolerance, *distances]))
    event = F.struct("score", "id", "t")
    lists = cut.groupBy("recording_id", "run").agg(F.collect_list(F.when(F.col("side") == 0, event)).alias("p"), *[F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t")))).alias(c) for n, c in ((1, "r"), (2, "b"))])
    cells = [(a, k) for a in range(len(distances)) for k in range(len(thresholds))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums: dict = {}
            for key, p, r, b in zip(frame["recording_id"], frame["p"], frame["r"], frame["b"], strict=True):
                counts = sums.setdefault(key, [np.zeros((len(distances), len(thresholds), 2), dtype=np.int64), 0])
                scores, ids, times = ([x[c] for x in p] for c in ("score", "id", "t"))
                if united:
                    counts[0] += _united(scores, times, list(b), list(r), thresholds, distances, tolerance)
                else:
                    counts[0] += _swept(scores, ids, times, list(r), thresholds, distances, tolerance)
                counts[1] += len(r)
            rows = [(key, a, k, int(n[a, k, 0]), int(n[a, k, 1]), r) for key, (n, r) in sums.items() for a, k in cells]
            yield pd.DataFrame(rows, columns=["recording_id", "a", "grid_idx", "kept", "tp", "refs"])

    united = base is not None
    kind = scored.schema["recording_id"].dataType.simpleString()
    parts = lists.select("recording_id", "p", "r", "b").mapInPandas(run, f"recording_id {kind}, a int, grid_idx int, kept long, tp long, refs long")
    out = parts.groupBy("recording_id", "a", "grid_idx").agg(F.sum("kept").alias("kept"), F.sum("tp").alias("tp"), F.sum("refs").alias("refs"))
    value = lambda values, at: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(at) + 1)
    return out.select("recording_id", "grid_idx", value(thresholds, "grid_idx").alias("threshold"), value(distances, "a").alias("distance"), "tp", (F.col("kept") - F.col("tp")).alias("fp"), (F.col("refs") - F.col("tp")).alias("fn"))


def choose(counts: DataFrame) -> tuple[float, float]:
    """Threshold and distance with the best macro, then least, then pooled f1; the first of equals."""
    macro = events.macro(counts, "threshold", "distance")
    both = macro.join(events.pooled(counts, "threshold", "distance").select("threshold", "distance", "f1"), ["threshold", "distance"])
    best = both.orderBy(F.desc("macro_f1"), F.desc("min_f1"), F.desc("f1"), "threshold", "distance").first()
    return best.threshold, best.distance


def nested(df: DataFrame, reference: DataFrame, kind: str = "logistic", thresholds: list[float] | None = None, distances: list[float] | None = None) -> DataFrame:
    """Counts on each recording by a model and settings that never saw it.

    df: recording_id, event_id, t, features, label. Settings come from models that leave one training recording out each. Linear kinds take a few jobs (``folds.nested``); others are fitted fold by fold.
    """
    if kind in ("logistic", "least_squares"):
        from prosodia.plans import folds

        return folds.nested(df, reference, kind, thresholds, distances)
    thresholds, distances = thresholds or [0.3, 0.4, 0.5, 0.6, 0.7], distances or [0.04, 0.05, 0.06, 0.07, 0.08]
    names = [r[0] for r in df.select("recording_id").distinct().orderBy("recording_id").collect()]  # recordings of an experiment
    out = None
    for held in names:
        train = df.filter(F.col("recording_id") != held)
        inner = None
        for name in (n for n in names if n != held):
            part = scores(fit(train.filter(F.col("recording_id") != name), kind), train.filter(F.col("recording_id") == name))
            inner = part if inner is None else inner.unionByName(part)
        t, d = choose(sweep(inner.select("recording_id", "event_id", "t", "score"), reference.filter(F.col("recording_id") != held), thresholds, distances))
        test = scores(fit(train, kind), df.filter(F.col("recording_id") == held)).select("recording_id", "event_id", "t", "score")
        one = sweep(test, reference.filter(F.col("recording_id") == held), [t], [d])
        out = one if out is None else out.unionByName(one)
    return out


def save(model: PipelineModel, path: str, **settings) -> None:
    """A model with the version of its layout and its settings."""
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"version": VERSION, **settings}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    settings = json.loads(SparkSession.getActiveSession().read.text(f"{path}/settings").first()[0])
    if settings.get("version") != VERSION:
        raise ValueError(f"model layout {settings.get('version')}, expected {VERSION}")
    return PipelineModel.load(f"{path}/model"), settings
