"""Detection of nuclei from two sources: fusion by evidence, greedy union, and pruning by words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.operators import events, intervals

WITHIN, BONUS = 0.060, 0.12


def fuse(candidates: DataFrame, nuclei: DataFrame, threshold: float, distance: float) -> DataFrame:
    """Candidates at or above the threshold, and nuclei of the second source that stand apart from them.

    candidates: recording_id, event_id, t, score. nuclei: recording_id, event_id, t, confidence. A nucleus scores the best candidate
    within 60 ms, or the threshold less one, and 0.12 of its confidence. Events: recording_id, event_id, t, score, origin.
    """
    key = "recording_id"
    kept = events.suppress(candidates.filter(F.col("score") >= threshold), key, "event_id", "t", "score", distance)
    ev = candidates.select(key, F.col("t").alias("ct"), F.col("score").alias("cs"))
    scored = intervals.band_evidence(nuclei, ev, key, "event_id", "t", "ct", "cs", WITHIN, threshold - 1, BONUS * F.col("confidence"))
    # ids of the two sources stay apart: the second source's are negative
    second = scored.withColumn("event_id", -F.col("event_id").cast("long") - 1)
    union = events.priority_union(kept.withColumn("event_id", F.col("event_id").cast("long")), second, key, "event_id", "t", distance)
    both = kept.select(key, F.col("event_id").cast("long").alias("event_id"), "score").unionByName(second.select(key, "event_id", "score"))
    return union.join(both, [key, "event_id"]).select(key, "event_id", "t", "score", F.when(F.col("origin") == "primary", "candidate").otherwise("rescued").alias("origin"))


def fuse_base_first(candidates: DataFrame, nuclei: DataFrame, threshold: float, distance: float) -> DataFrame:
    """All nuclei of the base detector, and candidates at or above the threshold that stand apart from all kept, in order of time.

    The scores of nuclei, and ids and columns, are those of ``fuse``; origin is base or rescued.
    """
    key = "recording_id"
    ev = candidates.select(key, F.col("t").alias("ct"), F.col("score").alias("cs"))
    scored = intervals.band_evidence(nuclei, ev, key, "event_id", "t", "ct", "cs", WITHIN, threshold - 1, BONUS * F.col("confidence"))
    first = scored.withColumn("event_id", -F.col("event_id").cast("long") - 1)
    second = candidates.filter(F.col("score") >= threshold).withColumn("event_id", F.col("event_id").cast("long"))
    union = events.priority_union(first, second, key, "event_id", "t", distance)
    both = first.select(key, "event_id", "score").unionByName(second.select(key, "event_id", "score"))
    return union.join(both, [key, "event_id"]).select(key, "event_id", "t", "score", F.when(F.col("origin") == "primary", "base").otherwise("rescued").alias("origin"))


def prune(detected: DataFrame, words: DataFrame, slack: int = 0, padding: float = 0.0) -> DataFrame:
    """Events with ``kept``: a word keeps as many as it has vowels (and slack), a word without vowels none."""
    return intervals.quota_topk(detected, words, "recording_id", "event_id", "t", "score", "start", "end", "word_idx", "vowels", 1.0, slack, padding)


def describe(pruned: DataFrame) -> DataFrame:
    """One row a recording: times and scores kept, rescued and pruned, in order."""
    arr = lambda c, cond: F.array_sort(F.collect_list(F.when(cond, F.col(c))))
    k = F.col("kept")
    return pruned.groupBy("recording_id").agg(arr("t", k).alias("times_seconds"), F.transform(F.array_sort(F.collect_list(F.when(k, F.struct("t", "score")))), lambda s: s["score"]).alias("event_scores"), arr("t", k & (F.col("origin") == "rescued")).alias("rescued_times_seconds"), arr("t", ~k).alias("pruned_times_seconds"))
