"""Selection, fusion and matching of events in one recording.

Greedy rules depend on what was kept before, so they fold over one recording's ordered array of
events inside the JVM (``aggregate``). Matching cuts recordings into runs that no pair can cross and
works run by run; clustering runs as a grouped function.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.operators import ordered
from prosodia.operators.intervals import range_join


def _greedy(ordered, kept0, distance: float):
    """Fold: an event is kept if it is at least ``distance`` from every one kept before."""
    clear = lambda kept, e: F.forall(kept, lambda k: F.abs(k["t"] - e["t"]) >= F.lit(float(distance)))
    return F.aggregate(ordered, kept0, lambda kept, e: F.when(clear(kept, e), F.concat(kept, F.array(e))).otherwise(kept))


def suppress(events: DataFrame, key: str, event_id: str, t: str, score: str, distance: float) -> DataFrame:
    """Non-maximum suppression: by falling score (ties: earlier event_id) keep what is ``distance`` from all kept."""
    e = F.struct((-F.col(score)).cast("double").alias("rank"), F.col(event_id).cast("long").alias("id"), F.col(t).cast("double").alias("t"))
    g = events.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("es"))
    g = g.select(key, F.explode(_greedy(F.col("es"), F.expr("cast(array() as array<struct<rank:double,id:bigint,t:double>>)"), distance)).alias("e"))
    return g.select(key, F.col("e.id").alias(event_id), F.col("e.t").alias(t), (-F.col("e.rank")).alias(score))


def priority_union(primary: DataFrame, secondary: DataFrame, key: str, event_id: str, t: str, distance: float, by: str | None = None) -> DataFrame:
    """All primary events, and each secondary one that is ``distance`` from every event kept so far.

    Secondary events are tried in order of time, or of falling ``by`` (a score); ties go by event_id.
    Those near a primary event are dropped by an anti join before anything is gathered.
    """
    p = primary.select(key, event_id, t, F.lit("primary").alias("origin"))
    rank = (F.col(t) if by is None else -F.col(by)).cast("double")
    s = secondary.select(key, event_id, t, rank.alias("__rank"))
    near = range_join(s, primary.select(F.col(key), F.col(t).alias("__pt")).withColumn("__ps", F.col("__pt")), key, t, "__pt", "__ps", distance * 2, distance)
    near = near.filter(F.abs(F.col(t) - F.col("__pt")) < distance).select(key, event_id).distinct()
    free = s.join(near, [key, event_id], "left_anti")
    e = F.struct(F.col("__rank").alias("rank"), F.col(event_id).cast("long").alias("id"), F.col(t).cast("double").alias("t"))
    g = free.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("es"))
    g = g.select(key, F.explode(_greedy(F.col("es"), F.expr("cast(array() as array<struct<rank:double,id:bigint,t:double>>)"), distance)).alias("e"))
    return p.unionByName(g.select(key, F.col("e.id").alias(event_id), F.col("e.t").alias(t), F.lit("secondary").alias("origin")))


def first_secondary(primary: DataFrame, secondary: DataFrame, key: str, event_id: str, t: str, distance: float) -> DataFrame:
    """Secondary events at least ``distance`` from every primary one (the part of the union without greed)."""
    near = range_join(secondary.select(key, event_id, t), primary.select(F.col(key), F.col(t).alias("__pt")).withColumn("__ps", F.col("__pt")), key, t, "__pt", "__ps", distance * 2, distance)
    return secondary.join(near.filter(F.abs(F.col(t) - F.col("__pt")) < distance).select(key, event_id).distinct(), [key, event_id], "left_anti")


def combined(first: DataFrame, second: DataFrame, strategy: str, key: str, event_id: str, t: str, distance: float) -> DataFrame:
    """``standalone`` (second alone), ``first_priority`` or ``second_priority``."""
    if strategy == "standalone":
        return second.select(key, event_id, t, F.lit("secondary").alias("origin"))
    if strategy == "first_priority":
        return priority_union(first, second, key, event_id, t, distance)
    if strategy == "second_priority":
        return priority_union(second, first, key, event_id, t, distance)
    raise ValueError(strategy)


def match(predicted: list[float], reference: list[float], tolerance: float) -> list[tuple[int, int]]:
    """One-to-one pairs within tolerance: as many as possible, then the least total distance.

    Both lists ascend. State (i, j) holds the best (pairs, error) of the first i predictions and j references. Of equal
    states skipping a prediction comes before skipping a reference before pairing; another choice must
    gain a pair or save more than 1e-12. Only references within tolerance of a prediction have states of its row: left of them
    the row above holds, right of them the last state; time and memory grow with the pairs within tolerance.
    """
    m = len(reference)
    low = high = start = 0
    above, above_end = [(0, 0.0)], (0, 0.0)  # states of the row above from ``start`` on
    rows: list[tuple[int, int, bytearray, bool]] = []
    for p in predicted:
        while low < m and p - reference[low] > tolerance:
            low += 1
        high = max(high, low)
        while high < m and reference[high] - p <= tolerance:
            high += 1
        at = lambda j, above=above, start=start, end=above_end: above[j - start] if j - start < len(above) else end
        best = at(low)
        row, steps, diagonal = [best], bytearray(high - low), best
        for j in range(low + 1, high + 1):
            left, best, how = best, at(j), 1
            straight = best
            if left[0] > best[0] or (left[0] == best[0] and left[1] < best[1] - 1e-12):
                best, how = left, 2
            pairs, error = diagonal[0] + 1, diagonal[1] + abs(p - reference[j - 1])
            if pairs > best[0] or (pairs == best[0] and error < best[1] - 1e-12):
                best, how = (pairs, error), 3
            row.append(best)
            steps[j - low - 1] = how
            diagonal = straight
        gained = best[0] > above_end[0] or (best[0] == above_end[0] and best[1] < above_end[1] - 1e-12)
        rows.append((low, high, steps, gained))
        above, above_end, start = row, best, low
    out, i, j = [], len(predicted), m
    while i and j:
        low, high, steps, gained = rows[i - 1]
        if j > high:
            i, j = (i, high) if gained else (i - 1, j)
        elif j <= low:
            i -= 1
        else:
            how = steps[j - low - 1]
            if how == 3:
                out.append((i - 1, j - 1))
            i, j = i - (how != 2), j - (how != 1)
    return out[::-1]


def match_count(predicted: list[float], reference: list[float], tolerance: float) -> int:
    """How many pairs ``match`` finds, by two pointers."""
    i = j = n = 0
    while i < len(predicted) and j < len(reference):
        gap = predicted[i] - reference[j]
        if abs(gap) <= tolerance:
            n, i, j = n + 1, i + 1, j + 1
        elif gap < 0:
            i += 1
        else:
            j += 1
    return n


def _sides(predicted: DataFrame, reference: DataFrame, key: str, t: str) -> DataFrame:
    p = predicted.groupBy(key).agg(F.array_sort(F.collect_list(F.col(t).cast("double"))).alias("p"))
    r = reference.groupBy(key).agg(F.array_sort(F.collect_list(F.col(t).cast("double"))).alias("r"))
    none = F.array().cast("array<double>")
    return p.join(r, key, "full").select(key, F.coalesce("p", none).alias("p"), F.coalesce("r", none).alias("r"))


def matched(predicted: DataFrame, reference: DataFrame, key: str, t: str, tolerance: float, event_id: str | None = None) -> DataFrame:
    """key, predicted, reference (times), with event_id also predicted_id and reference_id: a row a pair or unmatched event.

    Recordings are cut wherever no pair can cross: where both gaps between the sides exceed the tolerance. Each
    run is matched on its own, so a recording of any length spreads, and a run costs what its pairs within
    tolerance cost. Of unmatched events the other side is null. Rows without a key or time are left out.
    """
    side = lambda df, n: df.filter(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))).select(key, F.col(t).cast("double").alias("__t"), F.lit(n).alias("__side"), (F.col(event_id) if event_id else F.lit(None)).cast("long").alias("__id"))
    both = side(predicted, 0).unionByName(side(reference, 1))
    of = lambda n: F.when(F.col("__side") == n, F.col("__t"))
    order = ["__t", "__side", "__id"]
    near = ordered.carried(both, key, order, {"__lp": of(0), "__lr": of(1)}, {"__np": of(0), "__nr": of(1)})
    apart = lambda later, earlier: F.coalesce(F.col(later) - F.col(earlier) > tolerance, F.lit(True))
    cut = ordered.runs(near.withColumn("__cut", apart("__nr", "__lp") & apart("__np", "__lr")), key, "__t", order, F.col("__cut"), "__run")
    event = F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"))
    lists = cut.groupBy(key, "__run").agg(*[F.array_sort(F.collect_list(F.when(F.col("__side") == n, event))).alias(c) for n, c in ((0, "p"), (1, "r"))])

    @F.pandas_udf("array<struct<predicted:double,reference:double,predicted_id:long,reference_id:long>>")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, r, strict=True):
            found = match([x["t"] for x in a], [x["t"] for x in b], tolerance) if len(a) and len(b) else []
            pi, ri = {i for i, _ in found}, {j for _, j in found}
            one = [(a[i]["t"], b[j]["t"], a[i]["id"], b[j]["id"]) for i, j in found]
            one += [(x["t"], None, x["id"], None) for i, x in enumerate(a) if i not in pi]
            one += [(None, x["t"], None, x["id"]) for j, x in enumerate(b) if j not in ri]
            out.append([dict(zip(("predicted", "reference", "predicted_id", "reference_id"), x, strict=True)) for x in one])
        return pd.Series(out)

    rows = lists.select(key, F.explode(run("p", "r")).alias("m"))
    return rows.select(key, *[f"m.{c}" for c in ("predicted", "reference", *(("predicted_id", "reference_id") if event_id else ()))])


def match_events(predicted: DataFrame, reference: DataFrame, key: str, t: str, tolerance: float) -> DataFrame:
    """Per recording: tp, fp, fn, timing_median, and the matched pairs and unmatched times of both sides.

    timing_median is null without a pair. Unmatched times are listed by position, so repeated times stay apart.
    """
    p, r = F.col("predicted"), F.col("reference")
    count = lambda c: F.count_if(c)
    gathered = lambda c, x: F.array_sort(F.collect_list(F.when(c, x)))
    return matched(predicted, reference, key, t, tolerance).groupBy(key).agg(
        count(p.isNotNull() & r.isNotNull()).alias("tp"),
        count(r.isNull()).alias("fp"),
        count(p.isNull()).alias("fn"),
        F.median(F.abs(p - r)).alias("timing_median"),
        gathered(p.isNotNull() & r.isNotNull(), F.array(p, r)).alias("pairs"),
        gathered(p.isNull(), r).alias("missed"),
        gathered(r.isNull(), p).alias("extra"),
    )


def match_labels(candidates: DataFrame, reference: DataFrame, key: str, event_id: str, t: str, tolerance: float) -> DataFrame:
    """key, event_id, t, label: 1 for candidates that the matching pairs with a reference event."""
    ref = reference.select(key, t, F.lit(None).cast("long").alias(event_id))
    out = matched(candidates, ref, key, t, tolerance, event_id).filter("predicted is not null")
    return out.select(key, F.col("predicted_id").alias(event_id), F.col("predicted").alias(t), F.col("reference").isNotNull().cast("int").alias("label"))


def match_counts(predicted: DataFrame, reference: DataFrame, key: str, t: str, tolerance: float) -> DataFrame:
    """Per recording tp, fp, fn; the same tp as ``match_events``, as a fold inside the JVM for parameter sweeps.

    Both sides merge into one ascending array; a run over it with two waiting queues' heads is the two-pointer walk.
    """
    both = _sides(predicted, reference, key, t)
    empty = "cast(named_struct('i', 0, 'j', 0, 'n', 0L) as struct<i:int,j:int,n:bigint>)"
    state = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("p") + F.size("r"), F.lit(1))), F.expr(empty), lambda s, _: _two_pointer(s, tolerance))
    out = both.withColumn("tp", state["n"])
    return out.select(key, "tp", (F.size("p") - F.col("tp")).cast("long").alias("fp"), (F.size("r") - F.col("tp")).cast("long").alias("fn"))


def _two_pointer(s, tolerance: float):
    gap = F.get("p", s["i"]) - F.get("r", s["j"])
    make = lambda i, j, n: F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["n"] + n).cast("long").alias("n"))
    over = gap.isNull()
    return F.when(over, s).when(F.abs(gap) <= tolerance, make(1, 1, 1)).when(gap < 0, make(1, 0, 0)).otherwise(make(0, 1, 0))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def pooled(counts: DataFrame, *by: str) -> DataFrame:
    """Micro rates: counts summed (per ``by``), then the ratios."""
    return rates(counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def macro(counts: DataFrame, *by: str) -> DataFrame:
    """Mean and least f1 over recordings."""
    return rates(counts).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.min("f1").alias("min_f1"))


class _Open:
    """Open clusters, sorted by (median, number), once for each method that a cluster lacks."""

    def __init__(self, methods: set[str]):
        self.lacking: dict[str, list[tuple[float, int]]] = {m: [] for m in methods}

    def nearest(self, method: str, t: float, within: float) -> int | None:
        """The cluster without the method whose median is nearest to t and within reach; of equals the first made."""
        own = self.lacking[method]
        at = bisect_left(own, (t, -1))
        near = []
        if at < len(own):
            near.append((abs(own[at][0] - t), own[at][1]))
        if at:
            first = bisect_left(own, (own[at - 1][0], -1))
            near.append((abs(own[first][0] - t), own[first][1]))
        best = min(near, default=None)
        return best[1] if best and best[0] <= within else None

    def close(self, before: float) -> None:
        """Clusters that no later event can reach."""
        for own in self.lacking.values():
            at = bisect_left(own, (before, -1))
            if at > 64:  # rare enough to be cheap, often enough to stay short
                del own[:at]


def cluster(times: list[float], methods: list[str], within: float, support: int, apart: float) -> list[tuple[float, int]]:
    """Events of several methods, clustered online in time order, then suppressed.

    An event joins the nearest cluster whose running median is within ``within`` and that has no member of its
    method. Clusters with ``support`` members rank by (members, -spread, median), greatest first, and stay if
    ``apart`` from all kept. Returns (median, members) in time order. An event costs a search in the open clusters and a
    place for each method, not a look at every cluster.
    """
    groups: list[tuple[list[float], set[str]]] = []
    open_ = _Open(set(methods))
    for t, m in sorted(zip(times, methods, strict=True)):
        open_.close(t - within)
        k = open_.nearest(m, t, within)
        if k is None:
            k, was = len(groups), None
            groups.append(([], set()))
        else:
            was = _median(groups[k][0])
        members, used = groups[k]
        insort(members, t)
        used.add(m)
        now = _median(members)
        for method, own in open_.lacking.items():
            if was is not None and (method not in used or method == m):
                at = bisect_left(own, (was, k))
                if at < len(own) and own[at] == (was, k):
                    del own[at]
            if method not in used:
                insort(own, (now, k))
    ranked = sorted(((len(g), -float(np.std(g)), _median(g)) for g, _ in groups if len(g) >= support), reverse=True)
    kept: list[tuple[float, int]] = []
    for n, _, t in ranked:
        at = bisect_left(kept, (t, -1))
        if (at == 0 or abs(t - kept[at - 1][0]) >= apart) and (at == len(kept) or abs(kept[at][0] - t) >= apart):
            kept.insert(at, (t, n))
    return kept


def _median(members: list[float]) -> float:
    n = len(members)
    return float(np.mean(members[(n - 1) // 2 : n // 2 + 1]))


def cluster_events(events: DataFrame, key: str, t: str, method: str, within: float, support: int, apart: float) -> DataFrame:
    """key, t, support of the clusters of each recording.

    Recordings are cut where neighbours are further apart than clusters reach and suppress, so a long one spreads.
    Events without a recording, time or method are left out.
    """
    own = events.select(key, F.col(t).cast("double").alias("__t"), F.col(method).cast("string").alias("__m")).filter("__t is not null and __m is not null")
    cut = ordered.gap_runs(own, key, "__t", ["__t", "__m"], max(within, apart))

    lists = cut.groupBy(key, "run").agg(F.collect_list(F.struct("__t", "__m")).alias("es"))

    @F.pandas_udf("array<struct<t:double,support:long>>")
    def run(es: pd.Series) -> pd.Series:
        return pd.Series([[{"t": t, "support": n} for t, n in cluster([e["__t"] for e in own], [e["__m"] for e in own], within, support, apart)] for own in es])

    return lists.select(key, F.explode(run("es")).alias("c")).select(key, "c.t", "c.support")


def word_quota(first: list[tuple[float, float]], second: list[tuple[float, float]], words: list[tuple[float, float, int]], apart: float, bonus: float = 2.0) -> list[float]:
    """Times picked word by word: up to a word's count, by falling score, ``apart`` from all picked before.

    Events of the first source score ``bonus`` more; an event serves one word at most. Events are sorted once; a word looks at
    those inside it, an event at its picked neighbours.
    """
    lists = []
    for src, own in enumerate((first, second)):
        order = sorted(range(len(own)), key=lambda k, own=own: (own[k][0], k))
        lists.append(([own[k][0] for k in order], order, own, bonus * (src == 0)))
    picked: list[float] = []
    used: set[tuple[int, int]] = set()
    for start, end, count in words:
        inside = []
        for src, (times, order, own, more) in enumerate(lists):
            span = sorted(order[bisect_left(times, start) : bisect_right(times, end)])
            inside += [(own[k][1] + more, own[k][0], src, k) for k in span if (src, k) not in used]
        taken = 0
        for _, t, src, k in sorted(inside, key=lambda x: (-x[0], x[1])):
            if taken >= count:
                break
            at = bisect_left(picked, t)
            if (at == 0 or abs(t - picked[at - 1]) >= apart) and (at == len(picked) or abs(t - picked[at]) >= apart):
                picked.insert(at, t)
                used.add((src, k))
                taken += 1
    return picked


def word_quota_events(first: DataFrame, second: DataFrame, words: DataFrame, key: str, apart: float) -> DataFrame:
    """``word_quota`` per recording over (key, t, score) twice and (key, start, end, count)."""
    rows = lambda df, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in cols]))).alias(cols[-1] + "s"))
    a, b, w = rows(first, "t", "score").withColumnRenamed("scores", "a"), rows(second, "t", "score").withColumnRenamed("scores", "b"), rows(words, "start", "end", "count").withColumnRenamed("counts", "w")

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        some = lambda v: [] if v is None else list(v)
        return pd.Series([word_quota([(e["t"], e["score"]) for e in some(p)], [(e["t"], e["score"]) for e in some(q)], [(e["start"], e["end"], int(e["count"])) for e in some(r)], apart) for p, q, r in zip(x, y, z, strict=True)])

    return w.join(a, key, "left").join(b, key, "left").select(key, F.explode(run("a", "b", "w")).alias("t"))


def label_by_match(candidates: list[float], reference: list[float], tolerance: float) -> list[int]:
    """1 for candidates that ``match`` pairs with a reference event."""
    hit = {i for i, _ in match(candidates, reference, tolerance)}
    return [int(i in hit) for i in range(len(candidates))]


def label_near(candidates: list[float], reference: list[float], within: float = 0.040) -> list[int]:
    """1 for candidates with any reference event ``within``."""
    reference = sorted(reference)
    return [int(bisect_right(reference, t + within) > bisect_left(reference, t - within)) for t in candidates]
