"""Functions over ordered rows of one recording: gaps, runs, valleys, context, prominence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.operators import ordered as ordered_rows


def ordered(key: str, *by: str):
    return Window.partitionBy(key).orderBy(*by)


def pauses(words: DataFrame, key: str, order: str, start: str, end: str, label: str, least: float) -> DataFrame:
    """Gaps of at least ``least`` between neighbours: after, before, duration to two decimals."""
    w = ordered(key, order)
    gap = F.col(start) - F.lag(end).over(w)
    return words.select(key, F.lag(label).over(w).alias("after"), F.col(label).alias("before"), gap.alias("gap")).filter(F.col("gap") >= least).select(key, "after", "before", F.round("gap", 2).alias("duration"))


def pad_to_next(words: DataFrame, key: str, order: str, start: str, end: str, most: float = 0.080) -> DataFrame:
    """Add pad_end: half the gap to the next word, from 0 to ``most``; ``most`` after the last."""
    gap = (F.lead(start).over(ordered(key, order)) - F.col(end)) * 0.5
    return words.withColumn("pad_end", F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(most)))))


def drop_short(words: DataFrame, start: str, end: str, pad_end: str, least: float = 0.040) -> DataFrame:
    return words.filter(F.col(end) + F.col(pad_end) - F.col(start) >= least)


def median3(df: DataFrame, key: str, order: str, mask: str) -> DataFrame:
    """A boolean mask smoothed by the majority of three neighbours; ends count twice."""
    w, v = ordered(key, order), F.col(mask).cast("int")
    votes = F.coalesce(F.lag(v).over(w), v) + v + F.coalesce(F.lead(v).over(w), v)
    return df.withColumn("smoothed", votes >= 2)


def flux(df: DataFrame, key: str, order: str, spectrum: str) -> DataFrame:
    """L2 distance of each spectrum from the one before; 0 at first."""
    before = F.lag(spectrum).over(ordered(key, order))
    step = F.zip_with(F.col(spectrum), F.col("__before"), lambda a, b: (a - b) * (a - b))
    return df.withColumn("__before", before).withColumn("flux", F.coalesce(F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))).drop("__before")


def gaussian(values: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothing with a Gaussian cut at four deviations; ends repeat."""
    radius = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(values, dtype=float), radius, mode="edge"), k / k.sum(), mode="valid")


def smoothed(sigma: float):
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: gaussian(np.asarray(v), sigma).tolist() if len(v) else [])

    return run


def valleys(frames: DataFrame, peaks: DataFrame, key: str, frame: str, energy: str, width: int = 100) -> DataFrame:
    """Between neighbouring peaks (key, frame) the frame of least energy, the first of equals, ends included."""
    from prosodia.operators.intervals import range_join

    spans = peaks.select(key, F.col(frame).alias("from_peak"), F.lead(frame).over(ordered(key, frame)).alias("to_peak")).filter("to_peak is not null")
    pairs = range_join(frames.select(key, frame, energy), spans, key, frame, "from_peak", "to_peak", width)
    best = pairs.groupBy(key, "from_peak", "to_peak").agg(F.min(F.struct(energy, frame)).alias("b"))
    return best.select(key, "from_peak", "to_peak", F.col(f"b.{frame}").alias("valley"), F.col(f"b.{energy}").alias("energy"))


def longest_run(df: DataFrame, key: str, order: str, condition: Column) -> DataFrame:
    """The longest run of consecutive rows that meet a condition, the first of equals: key, first, last, length."""
    w = ordered(key, order)
    r = df.select(key, order, F.row_number().over(w).alias("__i"), condition.alias("__on")).filter("__on")
    r = r.withColumn("__g", F.col("__i") - F.row_number().over(w)).groupBy(key, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    pick = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("length"), "first"))
    return r.withColumn("__n", pick).filter("__n = 1").select(key, "first", "last", "length")


def f0_stability(df: DataFrame, key: str, order: str, f0: str) -> DataFrame:
    """1 - |f0 - mean of five| / 40, from 0 to 1; 0 for the two rows at either end and where f0 is missing."""
    w = ordered(key, order)
    near = F.avg(f0).over(w.rowsBetween(-2, 2))
    edge = F.lag(F.lit(1), 2).over(w).isNull() | F.lead(F.lit(1), 2).over(w).isNull()
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col(f0) - near) / 40))
    return df.withColumn("stability", F.when(edge, 0.0).otherwise(F.coalesce(s, F.lit(0.0))))


def candidate_gaps(df: DataFrame, key: str, frame: str, default: int = 50) -> DataFrame:
    w = ordered(key, frame)
    return df.withColumn("gap_before", F.coalesce(F.col(frame) - F.lag(frame).over(w), F.lit(default))).withColumn("gap_after", F.coalesce(F.lead(frame).over(w) - F.col(frame), F.lit(default)))


#: Frames of context around a candidate.
OFFSETS = (-10, -7, -4, -2, 0, 2, 4, 7, 10)


def context(df: DataFrame, key: str, order: str, value: str, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Values at fixed offsets as an array; beyond an end the end's value stands in."""
    w = ordered(key, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.coalesce(F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w), (F.first(value) if k < 0 else F.last(value)).over(whole))
    return df.withColumn("context", F.array(*[at(k) if k else F.col(value) for k in offsets]))


def local_prominence(df: DataFrame, key: str, order: str, value: str, radius: int = 12) -> DataFrame:
    """How far a value stands above the higher of the least values on its two sides, at least 0."""
    w = ordered(key, order)
    left, right = F.min(value).over(w.rowsBetween(-radius, 0)), F.min(value).over(w.rowsBetween(0, radius))
    return df.withColumn("prominence", F.greatest(F.lit(0.0), F.col(value) - F.greatest(left, right)))


def running_offset(df: DataFrame, order: str, length: str, apart: float = 1.0) -> DataFrame:
    """Where each recording begins if all follow each other ``apart`` seconds."""
    return ordered_rows.running(df, [F.col(order)], {"offset": (F.col(length) + apart).cast("double")}, inclusive=False)


def deltas(values: np.ndarray, width: int = 5) -> np.ndarray:
    """Regression slope over ``width`` frames; ends repeat."""
    half = width // 2
    padded = np.pad(np.asarray(values, dtype=float), [(half, half)] + [(0, 0)] * (np.ndim(values) - 1), mode="edge")
    n = len(values)
    return sum(k * (padded[half + k : half + k + n] - padded[half - k : half - k + n]) for k in range(1, half + 1)) / (2 * sum(k * k for k in range(1, half + 1)))


def segments_by_similarity(states: np.ndarray, norm: float, merge: float) -> list[tuple[int, int]]:
    """Greedy segments of frames: quiet frames (norm below ``norm``) end one; a frame joins while its cosine with the running mean reaches ``merge``."""
    out, start, centre, count = [], None, None, 0
    size = np.linalg.norm(states, axis=1)
    for i, x in enumerate(states):
        if size[i] < norm:
            if start is not None:
                out.append((start, i))
            start = None
            continue
        alike = start is not None and float(x @ centre) / (size[i] * np.linalg.norm(centre) + 1e-8) >= merge
        if alike:
            centre = (centre * count + x) / (count + 1)
            count += 1
            continue
        if start is not None:
            out.append((start, i))
        start, centre, count = i, x.astype(float).copy(), 1
    if start is not None:
        out.append((start, len(states)))
    return out


def similarity_segments(states: DataFrame, key: str, frame: str, vector: str, norm: float, merge: float) -> DataFrame:
    """key, first, last (exclusive) frame of each greedy segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        found = segments_by_similarity(np.stack(pdf[vector].to_numpy()).astype(float), norm, merge)
        f = pdf[frame].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(found), "first": [int(f[a]) for a, _ in found], "last": [int(f[b - 1]) + 1 for _, b in found]})

    return states.select(key, frame, vector).groupBy(key).applyInPandas(run, f"{key} {states.schema[key].dataType.simpleString()}, first long, last long")
