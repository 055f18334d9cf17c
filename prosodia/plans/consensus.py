"""Nucleus events from waveforms and states of a speech encoder: features by joins, training, detection.

One row a candidate frame. Its own tracks come from the acoustic detector; everything that relates it to other
events (segments of many settings, the detector's nuclei, the encoder's states around it, the reference) is a
band join on recording and time, so a recording of any length spreads. The parts meet in one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.functions import arrays, signal
from prosodia.operators import intervals, ordered, ranking, windows
from prosodia.plans import detection, folds, learn
from prosodia.sources.files import RATE

KEY = "recording_id"
#: States a second of the encoder; how far segments and nuclei count, and how wide a segment's vote is, in seconds.
STATES, REACH, VOTE = 50.0, 0.25, 0.020
#: A candidate is positive with a reference event so near.
NEAR = 0.040
THRESHOLDS, DISTANCES = [0.3, 0.4, 0.5, 0.6, 0.7], [0.04, 0.05, 0.06, 0.07, 0.08]
MARGINS = [-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]


def acoustic(waveforms: DataFrame, settings: signal.Settings = signal.PRODUCTION) -> DataFrame:
    """recording_id, event_id (frame), t, tracks (features), confidence (of nuclei of the detector; else null)."""
    kind = waveforms.schema[KEY].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, samples in zip(frame[KEY], frame["samples"], strict=True):
                found, t = signal.detect_nuclei(np.asarray(samples), RATE, settings)
                sure = {c["frame"]: c["confidence"] for c in found}
                at = np.array(sorted({*(k for k in signal.candidate_pool(t).tolist() if t["speech"][k]), *sure}), dtype=int)
                rows = signal.candidate_matrix(t, at)
                yield pd.DataFrame({KEY: [rec] * len(at), "event_id": at, "t": at * signal.HOP, "tracks": [r.tolist() for r in rows], "confidence": pd.Series([sure.get(k) for k in at.tolist()], dtype="float64")})

    return waveforms.select(KEY, "samples").mapInPandas(run, f"{KEY} {kind}, event_id long, t double, tracks array<double>, confidence double")


def middles(states: DataFrame, norms: list[float] = ranking.VOTE_NORMS, merges: list[float] = ranking.VOTE_MERGES) -> DataFrame:
    """recording_id, norm, merge, t: the middle of every segment of each setting; states: recording_id, frame, x."""
    kind = states.schema[KEY].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        x, at = np.stack(frame["x"].to_numpy()).astype(float), frame["frame"].to_numpy()
        rows = [(frame[KEY].iloc[0], a, b, (at[s] + at[e - 1] + 1) / 2 / STATES) for a in norms for b in merges for s, e in windows.segments_by_similarity(x, a, b)]
        return pd.DataFrame(rows, columns=[KEY, "norm", "merge", "t"])

    return states.select(KEY, "frame", "x").groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, norm double, merge double, t double")


def _near(events: DataFrame, others: DataFrame, reach: float, *columns: str) -> DataFrame:
    """Pairs of an event and another source's event within ``reach``, with __dt (other less own time)."""
    o = others.select(KEY, F.col("t").alias("__m"), *columns).withColumn("__to", F.col("__m"))
    return intervals.range_join(events.select(KEY, "event_id", "t"), o, KEY, "t", "__m", "__to", 2 * reach, reach).withColumn("__dt", F.col("__m") - F.col("t"))


def vote_features(events: DataFrame, segments: DataFrame, norms: list[float], merges: list[float]) -> DataFrame:
    """recording_id, event_id, votes (array): how the segmentations agree about an event.

    The smoothed vote at it and around it, its prominence, the vote by norm and by merge, the shares of settings with a
    middle within 20, 35 and 50 ms, and median and deviation of the distance to each setting's nearest middle.
    """
    pairs = _near(events, segments, REACH, "norm", "merge")
    weight = lambda shift: F.exp(-((F.col("__dt") - shift) ** 2) / (2 * VOTE**2))
    shifts = [k * signal.HOP for k in signal.OFFSETS]
    own = F.when(F.abs("__dt") <= 5 * VOTE, weight(0.0)).otherwise(0.0)
    by_setting = pairs.groupBy(KEY, "event_id", "norm", "merge").agg(F.min(F.abs("__dt")).alias("d"), F.sum(own).alias("v"), *[F.sum(weight(s)).alias(f"c{i}") for i, s in enumerate(shifts)])
    total = len(norms) * len(merges)
    per = by_setting.groupBy(KEY, "event_id").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(shifts))],
        *[F.sum(F.when(F.col("norm") == n, F.col("v")).otherwise(0.0)).alias(f"n{i}") for i, n in enumerate(norms)],
        *[F.sum(F.when(F.col("merge") == m, F.col("v")).otherwise(0.0)).alias(f"m{i}") for i, m in enumerate(merges)],
        *[(F.count_if(F.col("d") <= w) / total).alias(f"w{i}") for i, w in enumerate((0.020, 0.035, 0.050))],
        F.collect_list("d").alias("ds"),
    )
    ds = F.array_sort(F.concat("ds", F.array_repeat(F.lit(REACH), F.lit(total) - F.size("ds"))))
    per = per.withColumn("ds", ds)
    middle = (F.element_at("ds", (total + 1) // 2) + F.element_at("ds", total // 2 + 1)) / 2
    mean = F.aggregate("ds", F.lit(0.0), lambda s, x: s + x) / total
    deviation = F.sqrt(F.aggregate("ds", F.lit(0.0), lambda s, x: s + (x - mean) ** 2) / total)
    half = len(shifts) // 2
    side = lambda part: F.least(*[f"c{i}" for i in part])
    jut = F.greatest(F.lit(0.0), F.col(f"c{half}") - F.greatest(side(range(half + 1)), side(range(half, len(shifts)))))
    names = [*(f"c{i}" for i in range(len(shifts))), *(f"n{i}" for i in range(len(norms))), *(f"m{i}" for i in range(len(merges))), "w0", "w1", "w2"]
    return per.select(KEY, "event_id", F.array(*names, jut, middle, deviation).alias("votes"))


def state_features(events: DataFrame, states: DataFrame) -> DataFrame:
    """recording_id, event_id, context (array): norms of the states around an event and cosines between them."""
    at = F.round(F.col("t") * STATES).cast("long")
    want = events.select(KEY, "event_id", at.alias("frame")).withColumn("off", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("frame", F.col("frame") + F.col("off"))
    met = want.join(states.select(KEY, F.col("frame").cast("long").alias("frame"), F.col("x").cast("array<double>").alias("x")), [KEY, "frame"])
    norm = F.sqrt(arrays.dot(F.col("x"), F.col("x")) + 1e-8)
    at_ = lambda k: F.max(F.when(F.col("off") == k, F.col("x")))
    per = met.groupBy(KEY, "event_id").agg(F.max(F.when(F.col("off") == 0, norm)).alias("own"), F.avg(norm).alias("mean"), F.stddev_pop(norm).alias("deviation"), at_(-2).alias("a"), at_(0).alias("b"), at_(2).alias("c"))
    middle = F.coalesce("b", "a", "c")
    a, b, c = F.coalesce("a", middle), middle, F.coalesce("c", middle)
    known = lambda x: F.coalesce(x, F.lit(0.0))
    return per.select(KEY, "event_id", F.array(known(F.col("own")), known(F.col("mean")), known(F.col("deviation")), *(known(arrays.cosine(p, q)) for p, q in ((a, b), (b, c), (a, c)))).alias("context"))


def assembled(events: DataFrame, states: DataFrame, norms: list[float] = ranking.VOTE_NORMS, merges: list[float] = ranking.VOTE_MERGES) -> DataFrame:
    """recording_id, event_id, t, confidence, features of acoustic candidates: all parts in one vector."""
    n_votes = len(signal.OFFSETS) + len(norms) + len(merges) + 6
    nuclei = _near(events, events.filter("confidence is not null"), REACH).groupBy(KEY, "event_id").agg(F.min(F.abs("__dt")).alias("base"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    base = F.coalesce("base", F.lit(REACH))
    flag = lambda c: c.cast("double")
    votes = vote_features(events, middles(states, norms, merges), norms, merges)
    out = events.join(votes, [KEY, "event_id"], "left").join(state_features(events, states), [KEY, "event_id"], "left").join(nuclei, [KEY, "event_id"], "left")
    parts: list[Column] = [F.col("tracks"), F.coalesce("votes", zeros(n_votes)), F.coalesce("context", zeros(6)), F.array(base, flag(base <= 0.025), flag(base <= 0.050))]
    return out.select(KEY, "event_id", "t", "confidence", array_to_vector(F.concat(*parts)).alias("features"))


def labelled(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Add label: 1 with a reference event within 40 ms."""
    hit = _near(rows, reference, NEAR).select(KEY, "event_id").distinct().withColumn("label", F.lit(1))
    return rows.join(hit, [KEY, "event_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def held_out(rows: DataFrame, kind: str) -> DataFrame:
    """recording_id, event_id, t, score by a model that didn't see the recording."""
    if kind in ("logistic", "least_squares"):
        n = rows.select(KEY).distinct().count()
        return folds.held_out_scores(rows, folds.fit(rows, kind, [(i,) for i in range(n)]), pairs=False).drop("held")
    out = None
    for (name,) in sorted(rows.select(KEY).distinct().collect()):  # recordings of an experiment
        part = learn.scores(learn.fit(rows.filter(F.col(KEY) != name), kind), rows.filter(F.col(KEY) == name)).select(KEY, "event_id", "t", "score")
        part = ordered.written(part, "held-out")
        out = part if out is None else out.unionByName(part)
    return out


def train(waveforms: DataFrame, states: DataFrame, reference: DataFrame, path: str, kind: str = "kernel_svm", tolerance: float = 0.050) -> dict:
    """Fit on reference events (recording_id, t), choose threshold and distance on recordings left out, save; the settings.

    The settings are those of the best fused events: the base detector's nuclei first, then candidates.
    """
    rows = ordered.written(labelled(assembled(ordered.written(acoustic(waveforms), "acoustic"), states), reference), "rows")
    scored = held_out(rows, kind)
    thresholds = MARGINS if kind.endswith("svm") else THRESHOLDS
    counts = learn.sweep(scored, reference.select(KEY, "t"), thresholds, DISTANCES, tolerance, base=rows.filter("confidence is not null").select(KEY, "t"))
    threshold, distance = learn.choose(ordered.written(counts, "counts"))
    settings = {"kind": kind, "threshold": threshold, "distance": distance, "tolerance": tolerance, "norms": ranking.VOTE_NORMS, "merges": ranking.VOTE_MERGES}
    learn.save(learn.fit(rows, "logistic" if kind == "least_squares" else kind), path, **settings)
    return settings


def detect(waveforms: DataFrame, states: DataFrame, path: str, words: DataFrame | None = None, slack: int = 1) -> DataFrame:
    """A row a recording of a saved model's events (``detection.describe``); words prune what exceeds their vowels and slack.

    words: recording_id, word_idx, start, end, vowels. A model of another layout is refused.
    """
    model, settings = learn.load(path)
    base = ordered.written(acoustic(waveforms), "acoustic")
    rows = assembled(base, states, settings["norms"], settings["merges"])
    scored = ordered.written(learn.scores(model, rows).select(KEY, "event_id", "t", "confidence", "score"), "scored")
    nuclei = scored.filter("confidence is not null").select(KEY, "event_id", "t", "confidence")
    fused = detection.fuse_base_first(scored.select(KEY, "event_id", "t", "score"), nuclei, settings["threshold"], settings["distance"])
    kept = detection.prune(fused, words, slack) if words is not None else fused.withColumn("kept", F.lit(True))
    return detection.describe(kept)
