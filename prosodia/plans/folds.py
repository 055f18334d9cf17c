"""Leave-one-recording-out fits of linear detectors from sums by recording.

Every statistic of a fold's training rows is the total less that of the recordings left out. Least squares
needs one pass: each recording's moments. The logistic fit needs a pass a Newton step, in which each row
adds to the gradient and curvature of every fold that keeps its recording, so that all folds, the nested
ones of two recordings too, advance together. The number of jobs doesn't depend on the number of folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosodia.operators import events, ordered
from prosodia.plans import learn
from prosodia.plans.models import added, matrix

#: Bytes of what a task sums, at most.
MOST = 256 << 20


@dataclass
class Folds:
    """Recordings, the recordings that each fold leaves out (none, one or two), and its coefficients, constant last."""

    names: list
    left_out: list[tuple[int, ...]]
    coefficients: np.ndarray

    def of(self, *left_out) -> np.ndarray:
        return self.coefficients[self.left_out.index(tuple(sorted(self.names.index(x) for x in left_out)))]


class Moments:
    """Sums by (recording, label): rows, values and products of [x, 1]."""

    def __init__(self, names: list, sums: np.ndarray):
        self.names, self.sums = names, sums  # recordings x labels x p x p

    @property
    def width(self) -> int:
        return self.sums.shape[-1]

    def of_fold(self, left_out: tuple[int, ...]) -> np.ndarray:
        return self.sums.sum(axis=0) - sum(self.sums[i] for i in left_out) if left_out else self.sums.sum(axis=0)

    def scaling(self, fold: np.ndarray) -> np.ndarray:
        """Matrix that takes [x, 1] to [(x - mean) / deviation, 1] of the fold's rows; constant features become 0."""
        whole = fold.sum(axis=0)
        n, p = whole[-1, -1], self.width
        mean = whole[-1, :-1] / max(n, 1)
        variance = np.maximum((np.diag(whole)[:-1] - n * mean**2) / max(n - 1, 1), 0.0)
        scale = np.where(variance > 1e-14 * (1 + mean**2), 1 / np.sqrt(np.where(variance > 0, variance, 1.0)), 0.0)
        out = np.zeros((p, p))
        out[np.arange(p - 1), np.arange(p - 1)] = scale
        out[:-1, -1] = -mean * scale
        out[-1, -1] = 1.0
        return out

    @staticmethod
    def weights(fold: np.ndarray) -> np.ndarray:
        """What a row of each label weighs, so that both labels have half; their total is the number of rows."""
        n = fold[:, -1, -1]
        present = n > 0
        return np.where(present, n.sum() / (max(1, present.sum()) * np.where(present, n, 1.0)), 0.0)


def rows_of(df: DataFrame) -> DataFrame:
    return df.select("recording_id", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))


def moments(df: DataFrame) -> Moments:
    """Of (recording_id, features, label 0 or 1) rows, in one pass; recordings are those of one experiment."""
    names = sorted(r[0] for r in df.select("recording_id").distinct().collect())
    first = df.select(F.size(vector_to_array("features")).alias("d")).first()
    p = (first.d if first else 0) + 1
    if len(names) * 2 * p * p * 8 > MOST:
        raise ValueError(f"{len(names)} recordings of {p} features pass {MOST} bytes")
    index = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(index), 2, p, p))
        for b in batches:
            if not b.num_rows:
                continue
            z = np.hstack([matrix(b.column(1)), np.ones((b.num_rows, 1))])
            group = np.array([index[v] for v in b.column(0).to_pylist()]) * 2 + (b.column(2).to_numpy() >= 0.5)
            for g in np.unique(group):
                own = z[group == g]
                total[g // 2, g % 2] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["pid", "sums"])

    sums = added(rows_of(df).mapInArrow(run, "pid int, sums binary"), len(names) * 2 * p * p)
    return Moments(names, sums.reshape(len(names), 2, p, p))


def every_fold(n: int) -> list[tuple[int, ...]]:
    """Without one recording, and without two."""
    return [(i,) for i in range(n)] + list(combinations(range(n), 2))


def penalty(p: int, strength: float) -> np.ndarray:
    out = np.full(p, strength)
    out[-1] = 0.0  # the constant is free
    return np.diag(out)


def least_squares(m: Moments, left_out: list[tuple[int, ...]], strength: float = 0.01) -> Folds:
    """Balanced ridge fits of labels -1 and 1 on standardised features, one a fold, in terms of the raw features."""
    out = np.zeros((len(left_out), m.width))
    for i, fold in enumerate(left_out):
        own = m.of_fold(fold)
        if not own[:, -1, -1].sum():
            continue
        w, a = m.weights(own), m.scaling(own)
        gram = np.tensordot(w, own, axes=1)
        right = w[1] * own[1, -1] - w[0] * own[0, -1]
        n = gram[-1, -1]
        scaled = a @ gram @ a.T / n + penalty(m.width, strength)
        out[i] = np.linalg.lstsq(scaled, a @ right / n, rcond=None)[0] @ a
    return Folds(m.names, left_out, out)


def logistic(df: DataFrame, m: Moments, left_out: list[tuple[int, ...]], strength: float = 0.01, rounds: int = 30, close: float = 1e-9) -> Folds:
    """Balanced logistic fits with a squared penalty on standardised features, one a fold, by Newton steps on sums."""
    p, folds = m.width, len(left_out)
    length = folds * p * (p + 1)
    if length * 8 > MOST:
        raise ValueError(f"{folds} folds of {p} features pass {MOST} bytes")
    own = [m.of_fold(f) for f in left_out]
    scale, weight = np.stack([m.scaling(f) for f in own]), np.stack([m.weights(f) for f in own])
    size = np.array([max(f[:, -1, -1].sum(), 1) for f in own])
    keeps = np.ones((len(m.names), folds))
    for i, f in enumerate(left_out):
        keeps[list(f), i] = 0.0
    index = {n: i for i, n in enumerate(m.names)}
    rows, context = rows_of(df), df.sparkSession.sparkContext
    beta, shrink = np.zeros((folds, p)), penalty(p, strength)  # in standardised features
    for _ in range(rounds):
        shared = context.broadcast((np.einsum("fp,fpq->fq", beta, scale), weight, keeps, index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            raw, weight, keeps, index = shared.value
            slope, curve = np.zeros((folds, p)), np.zeros((folds, p, p))
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    z = np.hstack([matrix(part.column(1)), np.ones((part.num_rows, 1))])
                    y = (part.column(2).to_numpy() >= 0.5).astype(int)
                    w = keeps[[index[v] for v in part.column(0).to_pylist()]] * weight[:, y].T
                    q = 1 / (1 + np.exp(-np.clip(z @ raw.T, -500, 500)))
                    slope += (w * (q - y[:, None])).T @ z
                    bend = w * q * (1 - q)
                    for f in range(folds):
                        curve[f] += (z * bend[:, f : f + 1]).T @ z
            flat = np.concatenate([slope.ravel(), curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["pid", "sums"])

        flat = added(rows.mapInArrow(run, "pid int, sums binary"), length)
        slope, curve = flat[: folds * p].reshape(folds, p), flat[folds * p :].reshape(folds, p, p)
        slope = np.einsum("fpq,fq->fp", scale, slope) / size[:, None] + beta @ shrink
        curve = np.einsum("fpq,fqr,fsr->fps", scale, curve, scale) / size[:, None, None] + shrink
        step = np.stack([np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(curve, slope, strict=True)])
        # a step that is far too long for the local curvature is cut
        step *= np.minimum(1.0, 8.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
        beta = beta - step
        if np.abs(step).max(initial=0.0) < close:
            break
    return Folds(m.names, left_out, np.einsum("fp,fpq->fq", beta, scale))


def fit(df: DataFrame, kind: str, left_out: list[tuple[int, ...]] | None = None, strength: float = 0.01) -> Folds:
    """``least_squares`` or ``logistic`` for the given folds, all of one and two recordings by default."""
    m = moments(df)
    left_out = every_fold(len(m.names)) if left_out is None else left_out
    return least_squares(m, left_out, strength) if kind == "least_squares" else logistic(df, m, left_out, strength)


def held_out_scores(df: DataFrame, folds: Folds, pairs: bool = True) -> DataFrame:
    """held, recording_id, event_id, t, score: each row by every fold that leaves out its recording (``pairs``), or by the one without it alone.

    held is the other recording that the fold leaves out, or the row's own in the fold without it alone. A score is
    the linear form, or, of a logistic fit, what its curve makes of it; order and choice are the same.
    """
    n = len(folds.names)
    index = {name: i for i, name in enumerate(folds.names)}
    at = {f: i for i, f in enumerate(folds.left_out)}
    others = lambda i: range(n) if pairs else [i]
    pick = np.array([[at[(i,)] if i == j else at[tuple(sorted((i, j)))] for j in others(i)] for i in range(n)], dtype=np.int64).reshape(n, -1)
    shared = df.sparkSession.sparkContext.broadcast((folds.names, index, pick, folds.coefficients))
    kind = df.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index, pick, beta = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                z = np.hstack([matrix(part.column(3)), np.ones((part.num_rows, 1))])
                own = pick[[index[v] for v in part.column(0).to_pylist()]]
                score = np.take_along_axis(z @ beta.T, own, axis=1)
                take = pa.array(np.repeat(np.arange(part.num_rows), own.shape[1]))
                held = pa.array(names * part.num_rows, part.schema.field(0).type) if pairs else part.column(0)
                yield pa.RecordBatch.from_arrays([held, *(part.column(i).take(take) for i in range(3)), pa.array(1 / (1 + np.exp(-np.clip(score.ravel(), -500, 500))))], names=["held", "recording_id", "event_id", "t", "score"])

    rows = df.select("recording_id", F.col("event_id").cast("long").alias("event_id"), F.col("t").cast("double").alias("t"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, f"held {kind}, recording_id {kind}, event_id long, t double, score double")


def nested(df: DataFrame, reference: DataFrame, kind: str = "logistic", thresholds: list[float] | None = None, distances: list[float] | None = None, tolerance: float = 0.050, strength: float = 0.01) -> DataFrame:
    """recording_id, threshold, distance, tp, fp, fn: each recording by a model and settings that never saw it.

    The settings for a recording come from the models that leave out it and one other, each tried on that
    other: best macro, then least, then pooled f1, the first of equals. A handful of jobs whatever the number of recordings.
    """
    thresholds, distances = thresholds or [0.3, 0.4, 0.5, 0.6, 0.7], distances or [0.04, 0.05, 0.06, 0.07, 0.08]
    fits = fit(df, kind, strength=strength)
    scored = held_out_scores(df, fits)
    kind_of = df.schema["recording_id"].dataType
    both = F.concat(F.col("held").cast("string"), F.lit("\x1f"), F.col("recording_id").cast("string")).alias("recording_id")
    # each recording's reference once for every fold, as its scores are
    truth = reference.filter(F.col("recording_id").isin(fits.names)).select("recording_id", "t").withColumn("held", F.explode(F.lit(fits.names)))
    counts = learn.sweep(scored.select(both, "event_id", "t", "score"), truth.select(both, "t"), thresholds, distances, tolerance)
    name = lambda i, c: F.split_part("recording_id", F.lit("\x1f"), F.lit(i)).cast(kind_of).alias(c)
    counts = ordered.written(counts.select(name(1, "held"), name(2, "recording_id"), "threshold", "distance", "tp", "fp", "fn"), "counts")
    inner = counts.filter("held <> recording_id")
    by = ["held", "threshold", "distance"]
    rated = events.macro(inner, *by).join(events.pooled(inner, *by).select(*by, "f1"), by)
    first = Window.partitionBy("held").orderBy(F.desc("macro_f1"), F.desc("min_f1"), F.desc("f1"), "threshold", "distance")
    best = rated.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*by)
    outer = counts.filter("held = recording_id").drop("recording_id")
    return outer.join(best, by).select(F.col("held").alias("recording_id"), "threshold", "distance", "tp", "fp", "fn")
