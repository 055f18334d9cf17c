"""Clusters, quotas, alignments, ranks and offsets against the plain rules they stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.operators import align, events, stats, windows


def plain_clusters(times, methods, within, support, apart):
    groups = []
    for t, m in sorted(zip(times, methods, strict=True)):
        near = [(abs(float(np.median(g)) - t), k) for k, (g, used) in enumerate(groups) if m not in used and abs(float(np.median(g)) - t) <= within]
        if near:
            k = min(near)[1]
            groups[k][0].append(t)
            groups[k][1].add(m)
        else:
            groups.append(([t], {m}))
    kept = []
    for n, _, t in sorted(((len(g), -float(np.std(g)), float(np.median(g))) for g, _ in groups if len(g) >= support), reverse=True):
        if all(abs(t - k) >= apart for k, _ in kept):
            kept.append((t, n))
    return sorted(kept)


def test_clusters(spark):
    rng = random.Random(1)
    for k in range(400):
        n = rng.randint(0, 60)
        times = [round(rng.uniform(0, 4), 2 if k % 2 else 5) for _ in range(n)]
        methods = [rng.choice("abcde") for _ in range(n)]
        args = rng.choice([0.02, 0.1, 0.5]), rng.randint(1, 3), rng.choice([0.0, 0.05, 0.3])
        assert events.cluster(times, methods, *args) == plain_clusters(times, methods, *args)
    rows = [(r, round(rng.uniform(0, 90), 2), rng.choice("abc")) for r in ("x", "y") for _ in range(400)]
    df = spark.createDataFrame([*rows, ("x", None, "a"), (None, 1.0, "a"), ("x", 5.0, None)], "rec string, t double, m string").repartition(5)
    got = sorted(tuple(r) for r in events.cluster_events(df, "rec", "t", "m", 0.08, 2, 0.05).collect())
    want = sorted((r, t, n) for r in ("x", "y") for t, n in plain_clusters([t for q, t, _ in rows if q == r], [m for q, _, m in rows if q == r], 0.08, 2, 0.05))
    assert got == want


def test_a_long_recording_of_clusters():
    rng = np.random.default_rng(2)
    times = np.sort(rng.uniform(0, 4000, 60_000)).tolist()
    assert len(events.cluster(times, ["abcdef"[i] for i in rng.integers(0, 6, 60_000)], 0.05, 2, 0.02)) > 1000


def test_word_quotas():
    rng = random.Random(3)

    def plain(first, second, words, apart, bonus=2.0):
        picked, used = [], set()
        for start, end, count in words:
            inside = [(s + bonus * (src == 0), t, src, k) for src, own in enumerate((first, second)) for k, (t, s) in enumerate(own) if start <= t <= end and (src, k) not in used]
            taken = 0
            for _, t, src, k in sorted(inside, key=lambda x: (-x[0], x[1])):
                if taken < count and all(abs(t - p) >= apart for p in picked):
                    picked.append(t)
                    used.add((src, k))
                    taken += 1
        return sorted(picked)

    for _ in range(400):
        draw = lambda n: [(round(rng.uniform(0, 3), 2), round(rng.random(), 1)) for _ in range(rng.randint(0, n))]
        words = [(a := round(rng.uniform(0, 3), 1), a + rng.choice([0.2, 0.6]), rng.randint(0, 4)) for _ in range(rng.randint(0, 6))]
        first, second = draw(12), draw(12)
        assert events.word_quota(first, second, words, 0.07) == plain(first, second, words, 0.07)


def test_alignments_and_edits():
    rng = random.Random(4)

    def plain_align(system, ground):
        a, b = [w.lower() for w in system], [w.lower() for w in ground]
        cost = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        out, i, j = [], len(a), len(b)
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else 2):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif j and cost[i][j] == cost[i][j - 1] + 1:
                j -= 1
                out.append((None, j))
            else:
                i -= 1
                out.append((i, None))
        return out[::-1]

    def plain_edits(ref, hyp):
        best = [[(i + j, 0, i, j) for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
        for i in range(1, len(ref) + 1):
            for j in range(1, len(hyp) + 1):
                same = ref[i - 1] == hyp[j - 1]
                x, y, z = best[i - 1][j - 1], best[i - 1][j], best[i][j - 1]
                best[i][j] = min((x[0] + (not same), x[1] + (not same), x[2], x[3]), (y[0] + 1, y[1], y[2] + 1, y[3]), (z[0] + 1, z[1], z[2], z[3] + 1))
        return best[-1][-1][1:]

    for _ in range(500):
        a, b = ([rng.choice(["a", "B", "c", "b"]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert align.align(a, b) == plain_align(a, b) and align.edit_counts(a, b) == plain_edits(a, b)
    assert align.edit_counts(["w"] * 3, ["w"] * 40_000) == (0, 0, 39_997)
    long = [rng.choice("abcdef") for _ in range(3000)]
    assert align.edit_counts(long, long[5:]) == (0, 5, 0) and sum(i is not None and j is not None for i, j in align.align(long, long[7:])) == 2993


def test_ranks_and_offsets(spark):
    rng = random.Random(5)
    texts = [(i, [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, u array<string>").repartition(6)
    first, count = {}, {}
    for i, us in texts:
        for p, u in enumerate(us):
            first.setdefault(u, (i, p))
            count[u] = count.get(u, 0) + 1
    want = {u: (count[u], n) for n, u in enumerate(sorted(count, key=lambda u: (-count[u], first[u])), 1)}
    assert {r.unit: (r["count"], r["rank"]) for r in stats.unit_frequency(df, F.col("u"), ["id"]).collect()} == want
    lengths = [(i, rng.choice([0.5, 1.25, 2.0])) for i in range(50)]
    got = {r.id: r.offset for r in windows.running_offset(spark.createDataFrame(lengths, "id long, d double").repartition(7), "id", "d", 0.5).collect()}
    at = 0.0
    for i, d in lengths:
        assert got[i] == pytest.approx(at)
        at += d + 0.5


def test_differences_and_transferred_times_as_columns(spark):
    df = spark.createDataFrame([(["ма", "ла", "ко"], ["ма", "ло", "ко", "да"]), (["а"], []), (None, ["б"])], "r array<string>, h array<string>")
    rows = df.select(align.syllable_diff("r", "h").alias("d")).collect()
    assert [(e.position, e.expected, e.got, e.type) for e in rows[0].d.errors] == [(2, "ла", "ло", "substitution"), (4, align.NONE, "да", "insertion")]
    assert rows[0].d.match_ratio == pytest.approx(4 / 7) and [(e.expected, e.type) for e in rows[1].d.errors] == [("а", "deletion")] and rows[2].d.errors[0].type == "insertion"
    word = "struct<word:string,start:double,end:double,conf:double,timing_source:string>"
    mine = [("один", 0.0, 0.4, 0.9, None), ("два", 0.5, 0.9, 0.9, None), ("пять", 1.0, 1.5, 0.9, None)]
    other = [("один", 0.1, 0.5, 0.8, None), ("две", 0.6, 1.0, 0.8, None)]
    out = spark.createDataFrame([(mine, other)], f"a array<{word}>, b array<{word}>").select(align.merged_times("a", "b").alias("m")).first().m
    # two words against one: their span is scaled into the other's
    assert [(w.word, round(w.start, 3), round(w.end, 3), w.timing_source) for w in out] == [("один", 0.1, 0.5, "times"), ("два", 0.6, 0.76, "times"), ("пять", 0.8, 1.0, "times")]


def test_alignments_leave_arrow_memory_by_pieces(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    words = pa.array([[f"w{i % 7}{k}" for k in range(50)] for i in range(8000)])
    tracemalloc.start()
    out = align._by_pieces(words, words, lambda a, b: [len(a), len(b)], pa.list_(pa.int32()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all 800,000 words as objects take over 40 MB
    assert len(out) == 8000 and out[-1].as_py() == [50, 50] and peak < 15 << 20
    left, right = pa.array([["a", "b"], None, [], ["a", None, "c"]]), pa.array([["a", "c"], ["x"], None, ["a", "c", "c"]])
    want = [align.diff_words(a or [], b or []) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)]
    for most in (1, 3, 1000):
        monkeypatch.setattr(align, "AT_ONCE", most)
        assert align._by_pieces(left, right, align.diff_words, align._DIFFERENCE).to_pylist() == want
    assert align._by_pieces(left[:0], right[:0], align.diff_words, align._DIFFERENCE).to_pylist() == []
