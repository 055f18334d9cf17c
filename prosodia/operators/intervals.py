"""Joins between points and intervals, always within one key (a recording).

An inequality join has no key to shuffle on beyond the recording. ``range_join`` adds a time
bucket: an interval is listed in each bucket it touches, a point lies in exactly one, so the equality
join on (key, bucket) meets each pair at most once and long recordings spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, width: float, pad: float = 0.0, how: str = "inner", half_open: bool = False) -> DataFrame:
    """Pairs of a point and an interval of one key with start - pad <= t <= end + pad (< with half_open).

    ``width`` is the bucket size in the unit of t: about the length of a usual interval. ``how``: inner, or
    left to keep points without an interval. Columns of both sides must have different names but for the key.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width)))
    p = points.withColumn("__b", bucket(F.col(t)))
    i = intervals.withColumnRenamed(key, "__key")
    i = i.withColumn("__b2", F.explode(F.sequence(bucket(F.col(start) - pad), bucket(F.greatest(F.col(start) - pad, F.col(end) + pad)))))
    upper = F.col(t) < F.col(end) + pad if half_open else F.col(t) <= F.col(end) + pad
    on = (p[key] == i["__key"]) & (F.col("__b") == F.col("__b2")) & (F.col(t) >= F.col(start) - pad) & upper
    return p.join(i, on, how).drop("__b", "__b2", "__key")


def distance_to(t: Column, start: Column, end: Column) -> Column:
    """0 inside [start, end], else the distance to the nearer end."""
    return F.greatest(F.lit(0.0), start - t, t - end)


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, point_id: str, t: str, start: str, end: str, order: str, max_gap: float, width: float) -> DataFrame:
    """For each point the interval nearest to it within ``max_gap``: one row a point, nulls if there is none.

    Ties: nearer by distance, then nearer to the interval's middle, then the smaller ``order``.
    """
    pairs = range_join(points.select(key, point_id, t), intervals.select(key, start, end, order), key, t, start, end, width, max_gap)
    best = pairs.withColumn("__d", distance_to(F.col(t), F.col(start), F.col(end))).filter(F.col("__d") <= max_gap)
    best = best.groupBy(key, point_id).agg(F.min(F.struct(F.col("__d").alias("distance"), F.abs(F.col(t) - (F.col(start) + F.col(end)) / 2).alias("off_centre"), F.col(order), F.col(start), F.col(end))).alias("best"))
    return points.join(best, [key, point_id], "left").select(*[points[c] for c in points.columns], "best")


def assign_nuclei(words: DataFrame, candidates: DataFrame, key: str = "recording_id", max_gap: float = 0.080, width: float = 1.0) -> DataFrame:
    """Candidates (key, candidate_id, t) with word_idx and time_in_word; both null beyond max_gap of any word."""
    out = nearest_interval(candidates, words.select(key, "word_idx", "start", "end"), key, "candidate_id", "t", "start", "end", "word_idx", max_gap, width)
    return out.select(*candidates.columns, F.col("best.word_idx").alias("word_idx"), (F.col("t") - F.col("best.start")).alias("time_in_word"))


def containment_counts(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, interval_id: str, width: float) -> DataFrame:
    """Every interval with the number of points inside and its class: exactly_one, none or multiple."""
    pairs = range_join(points.select(key, t), intervals.select(key, interval_id, start, end), key, t, start, end, width)
    n = pairs.groupBy(key, interval_id).agg(F.count("*").alias("n_points"))
    out = intervals.join(n, [key, interval_id], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)).cast("long"))
    return out.withColumn("class", F.when(F.col("n_points") == 1, "exactly_one").when(F.col("n_points") == 0, "none").otherwise("multiple"))


def points_in_gaps(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, width: float) -> DataFrame:
    """Points that lie in no interval."""
    spread = intervals.select(F.col(key).alias("__key"), F.col(start).alias("__s"), F.col(end).alias("__e")).withColumn("__b2", F.explode(F.sequence(F.floor(F.col("__s") / width), F.floor(F.greatest("__s", "__e") / width))))
    p = points.withColumn("__b", F.floor(F.col(t) / width))
    return p.join(spread, (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__b2")) & F.col(t).between(F.col("__s"), F.col("__e")), "left_anti").drop("__b")


def labels_at(points: DataFrame, intervals: DataFrame, key: str, point_id: str, t: str, start: str, end: str, label: str, width: float) -> DataFrame:
    """Each point with the sorted labels of the intervals that contain it."""
    pairs = range_join(points.select(key, point_id, t), intervals.select(key, start, end, label), key, t, start, end, width)
    found = pairs.groupBy(key, point_id).agg(F.array_sort(F.collect_list(label)).alias("labels"))
    return points.join(found, [key, point_id], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def half_open_median(points: DataFrame, intervals: DataFrame, key: str, t: str, value: str, start: str, end: str, interval_id: str, width: float) -> DataFrame:
    """Each interval with the median of the values in [start, end); NaN and null don't count, none gives 0."""
    good = points.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(key, t, value)
    pairs = range_join(good, intervals.select(key, interval_id, start, end), key, t, start, end, width, half_open=True)
    m = pairs.groupBy(key, interval_id).agg(F.median(value).alias("median"))
    return intervals.join(m, [key, interval_id], "left").withColumn("median", F.coalesce("median", F.lit(0.0)))


def best_in_interval(points: DataFrame, intervals: DataFrame, key: str, t: str, value: str, start: str, end: str, interval_id: str, width: float) -> DataFrame:
    """Each interval with the time of its greatest value (the earliest of equals), or its middle if it holds no point."""
    pairs = range_join(points.select(key, t, value), intervals.select(key, interval_id, start, end), key, t, start, end, width)
    best = pairs.groupBy(key, interval_id).agg(F.max(F.struct(F.col(value), (-F.col(t)).alias("early"))).alias("b"))
    best = best.select(key, interval_id, (-F.col("b.early")).alias("best_t"))
    out = intervals.join(best, [key, interval_id], "left")
    return out.withColumn("seeded", F.col("best_t").isNotNull()).withColumn("best_t", F.coalesce("best_t", (F.col(start) + F.col(end)) / 2))


def segment_events(segments: DataFrame, peaks: DataFrame, key: str, method: str, width: float = 1.0) -> DataFrame:
    """Segments (key, segment_id, start, end) as events: their ``midpoint``, or the ``peak`` inside with most confidence."""
    if method == "midpoint":
        return segments.select(key, "segment_id", ((F.col("start") + F.col("end")) / 2).alias("t"))
    if method != "peak":
        raise ValueError(method)
    return best_in_interval(peaks, segments, key, "t", "confidence", "start", "end", "segment_id", width).select(key, "segment_id", F.col("best_t").alias("t"))


def band_evidence(events: DataFrame, evidence: DataFrame, key: str, event_id: str, t: str, e_t: str, e_score: str, tolerance: float, default: float, weight: Column | None = None) -> DataFrame:
    """Each event with the greatest evidence score within ``tolerance``, else ``default``, plus ``weight``."""
    ev = evidence.select(key, F.col(e_t).alias("__t"), F.col(e_score).alias("__score"))
    near = ev.withColumn("__lo", F.col("__t")).withColumn("__hi", F.col("__t"))
    pairs = range_join(events.select(key, event_id, t), near, key, t, "__lo", "__hi", tolerance * 2, tolerance)
    best = pairs.groupBy(key, event_id).agg(F.max("__score").alias("__best"))
    out = events.join(best, [key, event_id], "left").withColumn("score", F.coalesce("__best", F.lit(float(default))) + (weight if weight is not None else F.lit(0.0)))
    return out.drop("__best")


def clip_rebase(intervals: DataFrame, start: str, end: str, lo, hi) -> DataFrame:
    """Intervals cut to [lo, hi] with times counted from lo; what is empty then goes."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    a, b = F.greatest(F.col(start), lo), F.least(F.col(end), hi)
    return intervals.filter(b > a).withColumn("__a", a - lo).withColumn(end, b - lo).withColumn(start, F.col("__a")).drop("__a")


def within_span(points: DataFrame, spans: DataFrame, key: str, t: str) -> DataFrame:
    """Points inside their recording's [span_start, span_end]."""
    return points.join(spans.select(key, "span_start", "span_end"), key).filter(F.col(t).between(F.col("span_start"), F.col("span_end"))).drop("span_start", "span_end")


def annotation_span(intervals: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Span of a recording: its labelled intervals, else all its intervals, else its points."""
    i = intervals.groupBy(key).agg(*[f(F.when(F.trim("text") != "", F.col(c))).alias(n) for n, f, c in (("a", F.min, "start"), ("b", F.max, "end"))], F.min("start").alias("a2"), F.max("end").alias("b2"))
    p = points.groupBy(key).agg(F.min("t").alias("a3"), F.max("t").alias("b3"))
    return i.join(p, key, "full").select(key, F.coalesce("a", "a2", "a3").alias("span_start"), F.coalesce("b", "b2", "b3").alias("span_end"))


def overlapping(intervals: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Intervals that overlap their recording's span, cut to it."""
    j = intervals.join(spans.select(key, "span_start", "span_end"), key).filter((F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")))
    return j.withColumn("start", F.greatest("start", "span_start")).withColumn("end", F.least("end", "span_end")).drop("span_start", "span_end")


def quota_topk(events: DataFrame, words: DataFrame, key: str, event_id: str, t: str, score: str, start: str, end: str, word_id: str, quota: str, width: float, slack: int = 0, padding: float = 0.0, min_length: float = 0.05) -> DataFrame:
    """Each event with its word and whether a per-word quota keeps it; events outside words always stay.

    An event belongs to the word around it (start - padding <= t <= end + padding) whose middle is nearest
    relative to its length, then to the smaller word_id. A word keeps the ``quota + slack`` events with the
    greatest (score, t, event_id), none if its quota is 0. slack >= 99 keeps everything.
    """
    real = words.filter(F.col(end) > F.col(start)).select(key, word_id, start, end, quota)
    pairs = range_join(events.select(key, event_id, t), real, key, t, start, end, width, padding)
    mid = F.abs(F.col(t) - (F.col(start) + F.col(end)) / 2) / F.greatest(F.col(end) - F.col(start), F.lit(min_length))
    own = pairs.groupBy(key, event_id).agg(F.min(F.struct(mid.alias("d"), F.col(word_id), F.col(quota))).alias("w"))
    joined = events.join(own, [key, event_id], "left")
    rank = F.row_number().over(Window.partitionBy(key, F.col(f"w.{word_id}")).orderBy(F.desc(score), F.desc(t), F.desc(event_id)))
    allowed = F.when(F.col(f"w.{quota}") <= 0, 0).otherwise(F.col(f"w.{quota}") + slack)
    keep = F.col("w").isNull() | F.lit(slack >= 99) | (F.col("__rank") <= allowed)
    return joined.withColumn("__rank", rank).withColumn("kept", keep).withColumn("word", F.col(f"w.{word_id}")).drop("w", "__rank")


def partition_check(intervals: DataFrame, key: str, start: str, end: str, tolerance: float = 1e-7) -> DataFrame:
    """Each interval with what is wrong before it: gap, overlap, reversed, or null where it joins gaplessly."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    step = F.col(start) - F.col("__before")
    bad = F.when(F.col(end) <= F.col(start), "reversed").when(step > tolerance, "gap").when(step < -tolerance, "overlap")
    return intervals.withColumn("__before", before).withColumn("problem", bad).drop("__before")


def complete_partition(intervals: DataFrame, bounds: DataFrame, key: str, start: str, end: str, label: str, hairline: float = 1e-7) -> DataFrame:
    """Labelled spans as a gapless partition of [xmin, xmax]: gaps get an empty label, a later span loses overlap.

    A gap of at most ``hairline`` is closed by moving the later start.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    cut = intervals.join(bounds.select(key, "xmin", "xmax"), key).withColumn(start, F.greatest(start, "xmin")).withColumn(end, F.least(end, "xmax"))
    reach = F.greatest(F.col("xmin"), F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("xmin")))
    own = cut.withColumn("__reach", reach).withColumn("__a", F.greatest(F.col(start), F.col("__reach"))).filter(F.col(end) > F.col("__a") + hairline)
    own = own.withColumn("__from", F.when(F.col("__a") - F.col("__reach") <= hairline, F.col("__reach")).otherwise(F.col("__a")))
    spans = own.select(key, F.col("__from").alias(start), F.col(end), F.col(label))
    gaps = own.filter(F.col("__from") > F.col("__reach")).select(key, F.col("__reach").alias(start), F.col("__from").alias(end), F.lit("").alias(label))
    tail = bounds.join(own.groupBy(key).agg(F.max(end).alias("__last")), key, "left").withColumn("__last", F.coalesce("__last", "xmin")).filter(F.col("xmax") - F.col("__last") > hairline)
    return spans.unionByName(gaps).unionByName(tail.select(key, F.col("__last").alias(start), F.col("xmax").alias(end), F.lit("").alias(label)))


def allocate_positions(items: DataFrame, groups: DataFrame, key: str, item_pos: str, group_pos: str, size: str) -> DataFrame:
    """Items dealt in order to groups of given sizes: each item with its group; stops at the first group that overflows.

    A group belongs only if the running size up to it is within the number of items.
    """
    w = Window.partitionBy(key).orderBy(group_pos)
    g = groups.withColumn("__hi", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lo", F.col("__hi") - F.col(size))
    n = items.groupBy(key).agg(F.count("*").alias("__n"))
    g = g.join(n, key).filter(F.col("__hi") <= F.col("__n")).withColumn("__i", F.explode(F.expr(f"if({size} > 0, sequence(__lo + 1, __hi), array())")))
    i = items.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(item_pos)).cast("long"))
    return i.join(g.select(key, group_pos, "__i").withColumn("__i", F.col("__i").cast("long")), [key, "__i"]).drop("__i")


def hint_intervals(records: DataFrame, key: str) -> DataFrame:
    """Nested words as absolute syllable intervals, cut to their word's end: key, word_idx, syl_idx, start, end, text."""
    w = records.select(key, F.posexplode("wordAnalysis").alias("word_idx", "w"))
    s = w.select(key, "word_idx", "w", F.posexplode("w.syllableAnalysis").alias("syl_idx", "s"))
    return s.select(key, "word_idx", "syl_idx", (F.col("w.start") + F.col("s.startSec")).alias("start"), F.least(F.col("w.end"), F.col("w.start") + F.col("s.endSec")).alias("end"), F.col("s.syllable").alias("text"))
