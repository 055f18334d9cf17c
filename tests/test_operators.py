import random

import pytest
from pyspark.sql import functions as F

from prosodia.operators import align, events, intervals, ranking, records, stats, windows


def words(spark, rows):
    return spark.createDataFrame([("r", i, s, e, n) for i, (s, e, n) in enumerate(rows)], "recording_id string, word_idx int, start double, end double, vowels int")


def points(spark, rows, rec="r"):
    return spark.createDataFrame([(rec, i, t, s) for i, (t, s) in enumerate(rows)], "recording_id string, id long, t double, score double")


def test_assign(spark):
    c = points(spark, [(0.20, 1.0), (0.51, 1.0), (1.20, 1.0)]).withColumnRenamed("id", "candidate_id")
    got = {r.t: r for r in intervals.assign_nuclei(words(spark, [(0.10, 0.45, 1), (0.55, 0.85, 1)]), c).collect()}
    assert (got[0.20].word_idx, got[0.51].word_idx, got[1.20].word_idx) == (0, 1, None)
    assert got[0.51].time_in_word == pytest.approx(-0.04)
    one = intervals.assign_nuclei(words(spark, [(0.0, 0.6, 1), (0.5, 1.0, 1)]), points(spark, [(0.55, 1.0)]).withColumnRenamed("id", "candidate_id")).collect()
    assert len(one) == 1 and one[0].word_idx is not None


def kept(spark, rows, ws, slack):
    out = intervals.quota_topk(points(spark, rows), words(spark, ws), "recording_id", "id", "t", "score", "start", "end", "word_idx", "vowels", 1.0, slack)
    return sorted(r.t for r in out.filter("kept").collect())


def test_prune(spark):
    rows = [(0.10, 0.9), (0.20, 0.1), (0.30, 0.8), (0.90, 0.2)]
    assert kept(spark, rows, [(0.0, 0.5, 1)], 1) == [0.10, 0.30, 0.90]
    assert kept(spark, [(0.20, 0.5), (0.80, 0.5)], [(0.0, 0.5, 0)], 3) == [0.80]
    assert kept(spark, rows, [(0.0, 0.5, 0)], 99) == [0.10, 0.20, 0.30, 0.90]


def test_range_join_is_bucketed_and_complete(spark):
    rng = random.Random(3)
    p = [(rng.choice("ab"), i, rng.uniform(-5, 50)) for i in range(200)]
    v = [(rng.choice("ab"), i, s, s + rng.choice([0.0, 1.0, 12.0])) for i, s in enumerate(rng.uniform(-5, 50) for _ in range(60))]
    pd_, iv = spark.createDataFrame(p, "k string, p int, t double"), spark.createDataFrame(v, "k string, i int, s double, e double")
    for pad, half in ((0.0, False), (1.5, False), (0.0, True)):
        j = intervals.range_join(pd_, iv, "k", "t", "s", "e", 3.0, pad, half_open=half)
        assert "NestedLoop" not in j._jdf.queryExecution().executedPlan().toString()
        want = sorted((a, b) for k, a, t in p for k2, b, s, e in v if k == k2 and s - pad <= t and (t < e + pad if half else t <= e + pad))
        assert sorted((r.p, r.i) for r in j.collect()) == want


def test_partition(spark):
    s = spark.createDataFrame([("r", 0.5, 1.0, "a"), ("r", 0.9, 2.0, "b"), ("r", 2.00000001, 2.5, "c"), ("r", 1.2, 1.5, "in")], "recording_id string, start double, end double, text string")
    b = spark.createDataFrame([("r", 0.0, 3.0), ("none", 0.0, 1.0)], "recording_id string, xmin double, xmax double")
    out = intervals.complete_partition(s, b, "recording_id", "start", "end", "text")
    rows = [(r.start, r.end, r.text) for r in out.filter("recording_id = 'r'").orderBy("start").collect()]
    assert rows == [(0.0, 0.5, ""), (0.5, 1.0, "a"), (1.0, 2.0, "b"), (2.0, 2.5, "c"), (2.5, 3.0, "")]
    assert [(r.start, r.end) for r in out.filter("recording_id = 'none'").collect()] == [(0.0, 1.0)]
    assert out.transform(lambda d: intervals.partition_check(d, "recording_id", "start", "end")).filter("problem is not null").count() == 0


def test_spans_and_clips(spark):
    iv = spark.createDataFrame([("a", 0.0, 1.0, ""), ("a", 1.0, 2.0, "x"), ("b", 0.0, 4.0, " ")], "recording_id string, start double, end double, text string")
    pt = spark.createDataFrame([("c", 1.0, "N"), ("c", 3.0, "?")], "recording_id string, t double, mark string")
    span = {r.recording_id: (r.span_start, r.span_end) for r in intervals.annotation_span(iv, pt, "recording_id").collect()}
    assert span == {"a": (1.0, 2.0), "b": (0.0, 4.0), "c": (1.0, 3.0)}
    assert [(r.start, r.end) for r in intervals.clip_rebase(iv.filter("recording_id = 'a'"), "start", "end", 0.5, 1.5).orderBy("start").collect()] == [(0.0, 0.5), (0.5, 1.0)]
    assert records.confirmed(pt).count() == 1 and records.hide_after(pt, "t", "mark", 0.5).filter("mark = '?'").count() == 2
    sp = spark.createDataFrame([("a", 0.5, 1.5)], "recording_id string, span_start double, span_end double")
    assert [(r.start, r.end) for r in intervals.overlapping(iv, sp, "recording_id").orderBy("start").collect()] == [(0.5, 1.0), (1.0, 1.5)]
    assert intervals.within_span(pt.withColumn("recording_id", F.lit("a")), sp, "recording_id", "t").count() == 1


def test_match():
    assert events.match([0.10, 0.13, 0.50], [0.11, 0.49], 0.03) == [(0, 0), (2, 1)]
    rng = random.Random(1)
    for _ in range(300):
        a, b = sorted(rng.uniform(0, 2) for _ in range(rng.randint(0, 7))), sorted(rng.uniform(0, 2) for _ in range(rng.randint(0, 7)))
        assert len(events.match(a, b, 0.15)) == events.match_count(a, b, 0.15)


def test_match_frames(spark):
    p, r = points(spark, [(0.10, 0.0), (0.13, 0.0), (0.50, 0.0)]), points(spark, [(0.11, 0.0), (0.49, 0.0)])
    m = events.match_events(p, r, "recording_id", "t", 0.03).first()
    assert (m.tp, m.fp, m.fn, m.extra, m.missed) == (2, 1, 0, [0.13], []) and m.timing_median == pytest.approx(0.01)
    c = events.match_counts(p, r.union(points(spark, [(5.0, 0.0)], "other")), "recording_id", "t", 0.03)
    assert sorted((x.recording_id, x.tp, x.fp, x.fn) for x in c.collect()) == [("other", 0, 0, 1), ("r", 2, 1, 0)]
    total = events.pooled(c).first()
    assert (total.precision, total.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert events.rates(c).filter("recording_id = 'other'").first().f1 == 0.0


def test_greedy(spark):
    e = points(spark, [(0.0, 5.0), (0.05, 9.0), (0.12, 4.0), (0.30, 4.0)])
    assert sorted(r.t for r in events.suppress(e, "recording_id", "id", "t", "score", 0.06).collect()) == [0.05, 0.12, 0.30]
    p, s = points(spark, [(1.0, 1.0)]), points(spark, [(1.02, 1.0), (1.20, 1.0), (1.24, 9.0), (1.5, 1.0)])
    assert sorted(r.t for r in events.priority_union(p, s, "recording_id", "id", "t", 0.05).collect()) == [1.0, 1.20, 1.5]
    assert sorted(r.t for r in events.priority_union(p, s, "recording_id", "id", "t", 0.05, by="score").collect()) == [1.0, 1.24, 1.5]
    assert events.combined(p, s, "standalone", "recording_id", "id", "t", 0.05).count() == 4
    assert events.cluster([1.0, 1.01, 1.02, 3.0], ["a", "b", "a", "c"], 0.05, 2, 0.1) == [(1.005, 2)]
    assert events.word_quota([(0.1, 0.2), (0.2, 0.9)], [(0.3, 5.0)], [(0.0, 0.5, 2)], 0.05) == [0.2, 0.3]
    assert events.label_near([0.0, 1.0], [0.03]) == [1, 0] and events.label_by_match([0.0, 0.01], [0.0], 0.05) == [1, 0]


def test_alignment():
    assert align.align(["а", "Б", "в"], ["а", "б", "г", "в"]) == [(0, 0), (1, 1), (None, 2), (2, 3)]
    assert align.align(["x"], ["y"]) == [(0, 0)]
    assert align.diff_words(["один", "два"], ["один", "три", "пять"]) == {"correct": ["один"], "substituted": [{"expected": "два", "got": "три"}, {"expected": "—", "got": "пять"}], "missed": [], "inserted": []}
    assert align.edit_counts("один два три".split(), "один четыре пять".split()) == (2, 0, 0)
    assert align.edit_counts(["a", "b"], []) == (0, 2, 0) and align.edit_counts([], ["a"]) == (0, 0, 1)
    assert align.diff_syllables(["ма", "ма"], ["ма"])[0] == [{"position": 2, "expected": "ма", "got": "—", "type": "deletion"}]
    w = lambda *xs: [{"word": a, "start": s, "end": e, "conf": 1.0} for a, s, e in xs]
    merged = align.transfer_times(w(("да", 0, 1), ("нет", 1, 2), ("эм", 2, 3)), w(("да", 0.1, 0.9), ("нед", 1.1, 1.9)))
    assert [(m["word"], m["start"]) for m in merged[:2]] == [("да", 0.1), ("нет", pytest.approx(1.1))]


def test_wer(spark):
    rows = spark.createDataFrame([("a", "e", 3, 2, 0, 0), ("b", "e", 1, 0, 0, 3)], "recording_id string, engine string, words int, s int, d int, i int")
    assert {r.recording_id: r.wer for r in stats.wer(rows, "recording_id", "engine").collect()} == {"a": 66.67, "b": 300.0}
    assert stats.wer(rows, "engine").first().wer == 125.0


def test_tests_of_means(spark):
    import statistics as st

    a, b = [1.0, 2.0, 3.0, 4.0] * 3, [2.0, 4.0, 6.0] * 4
    df = spark.createDataFrame([("v", "u", x) for x in a] + [("v", "stressed", x) for x in b] + [("v", "few", 1.0)] * 2, "vowel string, position string, x double")
    rows = stats.compare(df, ["vowel"], "position", "stressed", "x").collect()
    assert len(rows) == 1
    r = rows[0]
    va, vb = st.variance(a) / 12, st.variance(b) / 12
    assert r.t == pytest.approx((st.mean(a) - st.mean(b)) / (va + vb) ** 0.5) and r.df == pytest.approx((va + vb) ** 2 / (va**2 / 11 + vb**2 / 11))
    assert r.sig in ("**", "***", "*") and r.ratio == pytest.approx(2.5 / 4)
    flat = spark.createDataFrame([("v", p, x) for p, x in (("u", 1.0), ("stressed", 1.0)) for _ in range(4)], "vowel string, position string, x double")
    f = stats.compare(flat, ["vowel"], "position", "stressed", "x").first()
    assert f.d == 0.0 and f.t is None and f.p is None and f.sig == "N<10"


def test_small_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "x double")
    assert df.agg(stats.p90("x").alias("p")).first().p == 9.0
    assert df.filter("x < 0").agg(stats.p90("x").alias("p")).first().p == 0.0
    assert df.filter("x < 0").agg(*stats.summary("x")).first().asDict() == {"mean": 0.0, "max": 0.0, "min": 0.0, "std": 0.0}
    v = spark.createDataFrame([(0.5, 0.01, 0.5, 0.01, True), (0.85, 0.01, None, None, True), (0.95, 0.01, 0.99, 0.01, True), (0.1, 0.0, 0.1, 0.0, False)], "a double, p double, c double, q double, t boolean")
    assert [r[0] for r in v.select(stats.verdict(F.col("a"), F.col("p"), F.col("c"), F.col("q"), F.col("t"))).collect()] == ["strong", "moderate", "not proven", "descriptive"]


def test_window_edges(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate([1.0, 5.0, 2.0, 8.0])], "recording_id string, frame int, v double")
    assert [r.context for r in windows.context(df, "recording_id", "frame", "v", (-2, 0, 2)).orderBy("frame").collect()] == [[1, 1, 2], [1, 5, 8], [1, 2, 8], [5, 8, 8]]
    assert [r.prominence for r in windows.local_prominence(df, "recording_id", "frame", "v", 1).orderBy("frame").collect()] == [0, 3, 0, 0]
    assert [r.smoothed for r in windows.median3(df.withColumn("m", F.col("v") > 4), "recording_id", "frame", "m").orderBy("frame").collect()] == [False, False, True, True]
    assert windows.longest_run(df, "recording_id", "frame", F.col("v") > 4).first().length == 1
    valley = windows.valleys(df, df.filter("v >= 5"), "recording_id", "frame", "v").first()
    assert (valley.from_peak, valley.to_peak, valley.valley) == (1, 3, 2)
    st = spark.createDataFrame([("r", i, [3.0, 0.0] if i < 4 else [0.0, 3.0]) for i in range(8)], "recording_id string, frame long, x array<double>")
    assert sorted((r.first, r.last) for r in windows.similarity_segments(st, "recording_id", "frame", "x", 1.0, 0.8).collect()) == [(0, 4), (4, 8)]
    off = windows.running_offset(spark.createDataFrame([("a", 2.0), ("b", 3.0)], "recording_id string, d double"), "recording_id", "d").orderBy("recording_id").collect()
    assert [r.offset for r in off] == [0.0, 3.0]


def test_grids(spark):
    assert ranking.grid(spark, **ranking.CONTOUR_AXES).count() == 750 and ranking.grid(spark, **ranking.GATE_AXES).count() == 324 and ranking.grid(spark, **ranking.SEGMENT_AXES).count() == 63
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 2.0)], "g string, grid_idx int, f double")
    assert ranking.first_best(df, ["g"], [F.col("f")]).first().grid_idx == 1
    assert ranking.eligible_best(df, F.col("f") < 2, F.desc("f")).first().grid_idx == 0 and ranking.eligible_best(df, F.col("f") > 9, F.desc("f")).first().f == 2.0
    c = spark.createDataFrame([(False, 0.0, 0.0, 0.0), (True, 0.0, 0.0, 0.0)], "weak_recovery boolean, periodicity double, strength double, vowel_likeness double")
    assert ranking.gate(c, ranking.grid(spark, periodicity=[0.5], strength=[0.0], vowel=[0.0])).count() == 1
    loo = ranking.leave_one_out(df.withColumn("g", F.col("grid_idx").cast("string")), "g")
    assert loo.filter("role = 'test'").count() == 3 and loo.count() == 9


def test_cosine_neighbours_of_every_row(spark, tmp_path):
    import numpy as np

    from prosodia import catalog

    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(7)]
    v = {i: np.array(x) for i, x in rows}
    cos = lambda a, b: round(float(v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b]) + 1e-8)), 12)
    want = {a: sorted((-cos(a, b), b) for b in v if b != a) for a in v}
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (300, None)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    e = df.withColumnRenamed("embedding", "v")
    queries = ((catalog.QUERIES[q](spark, str(tmp_path)), n) for q, n in (("cosine_topk", 5), ("cosine_topk_all", 20)))
    for out, n in ((ranking.cosine_neighbours(e, 5), 5), (ranking.cosine_neighbours(e, 5, block=20), 5), *queries):
        got = {}
        for r in out.orderBy("a", F.desc("cosine"), "b").collect():
            got.setdefault(r.a, []).append((r.cosine, r.b))
        assert got.keys() == want.keys()
        for a in want:
            assert [b for _, b in sorted((-round(x, 6), b) for x, b in got[a])] == [b for _, b in sorted((round(x, 6), b) for x, b in want[a][:n])]
    assert ranking.cosine_neighbours(e.limit(0), 5).collect() == []


def test_cosine_neighbours_meet_copies_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = [[float(np.float32(x)) for x in rng.normal(size=4)] for _ in range(30)]
    # copies, a zero vector, an id of two different rows, tiny and infinite lengths
    rows = [(i, base[i % 30]) for i in range(240)] + [(900, [0.0] * 4), (3, base[7]), (3, [1e-6, 0.0, 0.0, 2e-6]), (901, [1e-5] * 4), (902, [float("inf"), 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        cos = np.round(x @ x.T / (norm[:, None] * norm[None, :] + 1e-8), 12)
    pairs = sorted((a, np.isnan(c) and -np.inf or -c, b) for i, a in enumerate(ids.tolist()) for b, c in zip(ids.tolist(), cos[i].tolist(), strict=True) if a != b)
    want, seen = [], {}
    for a, c, b in pairs:
        seen[a] = seen.get(a, 0) + 1
        if seen[a] <= 6:
            want.append((a, b))
    for kw in ({}, {"block": 20, "part": 33}):
        out = ranking.cosine_neighbours(df, 6, **kw)
        assert sorted((r.a, r.b) for r in out.collect()) == sorted(want)
    # eight copies of thirty vectors are met as thirty
    nearest = ranking.Nearest(np.arange(5), np.zeros(5, bool), x[:5], 3)
    nearest.meet(ids[:30], x[:30])
    kept = np.concatenate([k for _, k, _ in nearest.found()])
    assert len(kept) == 15 and set(kept[::3]) == set(range(5))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_plot_in_one_pass(spark):
    syl = "array<struct<syllable:string,startSec:double,endSec:double,acoustics:struct<core:struct<startInSyl:double,endInSyl:double>>>>"
    rows = [("r", 0, "да", 1.0, 2.0, [("да", 0.0, 0.5, (None,)), ("нет", 0.5, 1.0, ((0.1, 0.2),)), ("э", None, 1.0, None)], [(1.25, 0.5), (1.5, None)]), ("r", 1, "ну", 3.0, 4.0, None, None)]
    df = spark.createDataFrame(rows, f"recording_id string, word_idx int, word string, start double, end double, syllableAnalysis {syl}, v2Nuclei array<struct<timeSec:double,confidence:double>>")
    out = records.word_plot(df)
    want = [(0, "word", 1.0, 2.0, "да"), (0, "syllable", 1.0, 1.5, "да"), (0, "syllable", 1.5, 2.0, "нет"), (0, "syllable", None, 2.0, "э"), (0, "core", 1.6, 1.7, "нет"), (0, "nucleus", 1.25, 1.25, "0.50"), (0, "nucleus", 1.5, 1.5, "nu"), (1, "word", 3.0, 4.0, "ну")]
    assert out.columns == ["recording_id", "word_idx", "layer", "start", "end", "label"]
    assert [tuple(r)[1:] for r in out.collect()] == want
    assert plan(out).count("Scan") == 1


def test_reduction_in_one_sort(spark):
    rows = [("a", 0, 0, 1.0, 1.0, 1.0), ("a", 1, 0, 0.5, 0.5, 0.5), ("a", 2, 0, 0.9, 0.1, None), ("a", 3, 0, 0.1, 0.1, -1.0), ("b", 0, None, 1.0, 1.0, 1.0), ("b", 1, None, 1.0, 1.0, 1.0)]
    rows += [(None, 0, 0, 1.0, 1.0, 1.0), (None, 1, 0, 1.0, 1.0, 1.0), ("c", 0, 0, 0.0, 1.0, 1.0), ("c", 0, 0, 9.0, 9.0, 9.0), ("c", 1, 0, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "w string, i int, st int, q double, e double, c double")
    out = stats.reduction_per_group(df, ["w"], "i", "st", "q", "e", "c", F.lit(True))
    got = {r.w: (r.checked, r.errors, round(r.reduction_score, 3), r.has_issue) for r in out.collect()}
    # two stressed units are each compared; words without a key or a stressed unit have nothing to check
    assert got == {"a": (3, 1, 66.667, True), "b": (0, 0, 100.0, False), None: (0, 0, 100.0, False), "c": (2, 1, 50.0, True)}
    assert plan(out).count("Join") == 0


def test_reduction_query_holds_one_exchange(spark, tmp_path):
    from prosodia import catalog

    rows = [(1, 1, 5.0, 1.0, 0.1), (1, 1, 5.0, 1.0, 0.1), (1, 2, 5.0, 1.0, 0.1), (1, 2, 5.0, 1.0, 0.1), (2, 1, 5.0, 1.0, 0.1), (2, 1, 6.0, 1.0, 0.1), (2, 2, 1.0, 1.0, 0.1), (3, 4, 1.0, None, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["reduction_per_group"](spark, str(tmp_path))
    assert sorted((r.l_orderkey, r.checked, r.errors, r.has_issue) for r in out.collect()) == [(1, 1, 1, True), (2, 0, 0, False), (3, 0, 0, False)]
    text = plan(out).split("Initial Plan")[-1]
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1
