"""Matching by runs, sweeps in one pass, leave-one-out by sums, and the model families Spark lacks: all against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from prosodia.operators import events, ordered
from prosodia.plans import folds, learn, models


def full_table(predicted, reference, tolerance):
    """Every state of the table, then back from its end."""
    n, m = len(predicted), len(reference)
    g = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    how = [[0] * (m + 1) for _ in range(n + 1)]
    better = lambda a, b: a[0] > b[0] or (a[0] == b[0] and a[1] < b[1] - 1e-12)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best, h = g[i - 1][j], 1
            if better(g[i][j - 1], best):
                best, h = g[i][j - 1], 2
            gap = abs(predicted[i - 1] - reference[j - 1])
            pair = (g[i - 1][j - 1][0] + 1, g[i - 1][j - 1][1] + gap)
            if gap <= tolerance and better(pair, best):
                best, h = pair, 3
            g[i][j], how[i][j] = best, h
    out, i, j = [], n, m
    while i and j:
        h = how[i][j]
        if h == 3:
            out.append((i - 1, j - 1))
        i, j = i - (h != 2), j - (h != 1)
    return out[::-1]


def test_band_gives_the_whole_tables_pairs():
    rng = random.Random(1)
    for k in range(1500):
        step = rng.choice([0.05, 0.1, 1.0])
        draw = lambda n: sorted(round(rng.uniform(0, 3) / step) * step if k % 2 else rng.uniform(0, 3) for _ in range(rng.randint(0, n)))  # noqa: B023, E731
        a, b, tolerance = draw(14), draw(14), rng.choice([0.0, 0.05, 0.1, 0.3, 1.0])
        assert events.match(a, b, tolerance) == full_table(a, b, tolerance)
    assert events.match([0.10, 0.13, 0.50], [0.11, 0.49], 0.03) == [(0, 0), (2, 1)]
    assert events.match([0.1], [0.05, 0.15], 0.05) == [(0, 0)]  # of equal errors the earlier reference


def test_a_long_recording_needs_no_table_of_all_pairs():
    rng = np.random.default_rng(0)
    a, b = np.sort(rng.uniform(0, 2e5, 200_000)), np.sort(rng.uniform(0, 2e5, 200_000))
    found = events.match(a.tolist(), b.tolist(), 0.4)
    assert len(found) == events.match_count(a.tolist(), b.tolist(), 0.4) > 50_000


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    p, r = [], []
    for rec in ("a", "b", "c"):
        for out, n in ((p, 300), (r, 260)):
            out += [(rec, i, round(rng.uniform(0, 60), rng.choice([1, 3]))) for i in range(n)]
    p += [("only", 1, 5.0), ("only", 2, 5.0), (None, 3, 1.0), ("a", 999, None)]
    r += [("none", 1, 5.0), (None, 3, 1.0)]
    make = lambda rows: spark.createDataFrame(rows, "recording_id string, id long, t double").withColumn("extra", F.lit(1))
    return p, r, make(p), make(r)


def test_runs_give_the_same_pairs(spark, sides):
    p, r, pdf, rdf = sides
    for tolerance in (0.05, 0.2):
        for left, right in ((pdf, rdf), (pdf.repartition(7, "t"), rdf.orderBy(F.desc("t")))):
            got = {x.recording_id: x for x in events.match_events(left, right, "recording_id", "t", tolerance).collect()}
            assert got.keys() == {"a", "b", "c", "only", "none"}
            for rec, x in got.items():
                a, b = (sorted(t for q, _, t in side if q == rec and t is not None) for side in (p, r))
                found = full_table(a, b, tolerance)
                assert (x.tp, x.fp, x.fn) == (len(found), len(a) - len(found), len(b) - len(found))
                assert x.pairs == [[a[i], b[j]] for i, j in found]
                assert x.missed == [t for j, t in enumerate(b) if j not in {j for _, j in found}] and x.extra == [t for i, t in enumerate(a) if i not in {i for i, _ in found}]
                gaps = [abs(a[i] - b[j]) for i, j in found]
                assert x.timing_median == (pytest.approx(float(np.median(gaps))) if gaps else None)
    labels = events.match_labels(pdf, rdf, "recording_id", "id", "t", 0.2).collect()
    assert len(labels) == sum(q is not None and t is not None for q, _, t in p) and len({(x.recording_id, x.id) for x in labels}) == len(labels)
    by = defaultdict(int)
    for x in labels:
        by[x.recording_id] += x.label
    assert by["a"] == len(full_table(sorted(t for q, _, t in p if q == "a" and t is not None), sorted(t for q, _, t in r if q == "a"), 0.2))
    assert events.match_events(pdf.limit(0), rdf.limit(0), "recording_id", "t", 0.1).collect() == []


def test_carried_values_and_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz") if i % 3 else "hot", round(rng.uniform(0, 9), 2), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1000, 1)], "k string, t double, id long, v int").repartition(6)
    got = {r.id: (r.before, r.after) for r in ordered.carried(df, "k", ["t", "id"], {"before": F.col("v")}, {"after": F.col("v")}).collect()}
    for k, t, i, _ in rows:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        at = [x[2] for x in own].index(i)
        assert got[i] == (max((x[3] for x in own[:at] if x[3]), default=None), min((x[3] for x in own[at:] if x[3]), default=None))
    ranks = {r.id: r["rank"] for r in ordered.ranked(df, [F.col("t"), F.col("id")]).collect()}
    want = sorted([*rows, (None, 1.0, 1000, 1)], key=lambda x: (x[1], x[2]))
    assert ranks == {x[2]: n for n, x in enumerate(want, start=1)}
    sums = {r.id: r.s for r in ordered.running(df, [F.col("t"), F.col("id")], {"s": F.col("v")}, inclusive=False).collect()}
    total = 0
    for x in want:
        assert sums[x[2]] == total
        total += x[3] or 0


def test_sweep_equals_the_grid(spark):
    rng = random.Random(4)
    scored = [(rec, i, round(rng.uniform(0, 20), 2), round(rng.random(), 2)) for rec in "abc" for i in range(120)] + [("a", 500, 1.0, None), ("a", 501, None, 0.5)]
    truth = [(rec, round(rng.uniform(0, 20), 2)) for rec in "abd" for _ in range(60)]
    thresholds, distances, tolerance = [0.9, 0.2, 0.5, 0.7], [0.05, 0.4, 0.1], 0.15
    out = learn.sweep(spark.createDataFrame(scored, "recording_id string, event_id long, t double, score double"), spark.createDataFrame(truth, "recording_id string, t double"), thresholds, distances, tolerance).collect()
    got = {(r.recording_id, r.grid_idx, r.threshold, r.distance): (r.tp, r.fp, r.fn) for r in out}
    assert len(got) == len(out) == 4 * 4 * 3
    for rec in "abcd":
        refs = sorted(t for r, t in truth if r == rec)
        for k, th in enumerate(thresholds):
            for d in distances:
                kept = []
                for _, t in sorted(((-s, i), t) for r, i, t, s in scored if r == rec and s is not None and t is not None and s >= th):
                    if all(abs(t - x) >= d for x in kept):
                        kept.append(t)
                tp = events.match_count(sorted(kept), refs, tolerance)
                assert got[rec, k, th, d] == (tp, len(kept) - tp, len(refs) - tp)


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for rec in ("a", "b", "c", "d", "e"):
        for i in range(60):
            y = int(rng.random() < 0.4)
            x = rng.normal(0, 1, 3) + y * np.array([1.0, -0.5, 0.2]) + ord(rec) % 3
            rows.append((rec, i, i * 0.2, Vectors.dense([*x, 7.0]), y))  # the last feature is constant
            if y:
                truth.append((rec, i * 0.2 + float(rng.uniform(-0.03, 0.03))))
    df = spark.createDataFrame(rows, ["recording_id", "event_id", "t", "features", "label"])
    return rows, truth, df, spark.createDataFrame(truth, "recording_id string, t double")


def separate(rows, left_out, kind, strength=0.01):
    """One fold on its own rows: standardise, weigh, fit."""
    own = [r for r in rows if r[0] not in left_out]
    x, y = np.array([r[3].toArray() for r in own]), np.array([r[4] for r in own])
    scale = x.std(axis=0, ddof=1)
    z = np.hstack([np.where(scale > 1e-9, (x - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), 0), np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = np.diag([strength] * (z.shape[1] - 1) + [0.0])
    if kind == "least_squares":
        beta = np.linalg.lstsq((z * w[:, None]).T @ z / len(y) + p, (z * w[:, None]).T @ (2 * y - 1) / len(y), rcond=None)[0]
    else:
        beta = np.zeros(z.shape[1])
        for _ in range(60):
            q = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.lstsq((z * (w * q * (1 - q))[:, None]).T @ z / len(y) + p, z.T @ (w * (q - y)) / len(y) + p @ beta, rcond=None)[0]
    raw = np.where(scale > 1e-9, beta[:-1] / np.where(scale > 1e-9, scale, 1), 0)
    return np.array([*raw, beta[-1] - raw @ x.mean(axis=0)])


@pytest.mark.parametrize("kind", ["least_squares", "logistic"])
def test_folds_equal_separate_fits(candidates, kind):
    rows, _, df, _ = candidates
    out = folds.fit(df, kind)
    assert len(out.left_out) == 5 + 10
    for left_out in (("a",), ("e",), ("b", "d"), ("a", "c")):
        assert out.of(*left_out) == pytest.approx(separate(rows, left_out, kind), abs=1e-6)


def test_nested_settings_never_saw_the_recording(spark, candidates):
    rows, truth, df, reference = candidates
    thresholds, distances = [0.3, 0.5, 0.6], [0.05, 0.3]
    got = {r.recording_id: (r.threshold, r.distance, r.tp, r.fp, r.fn) for r in folds.nested(df, reference, "logistic", thresholds, distances).collect()}
    names = sorted({r[0] for r in rows})

    def counts(name, left_out, threshold, distance):
        beta = separate(rows, left_out, "logistic")
        kept = []
        for s, t in sorted((-float(1 / (1 + np.exp(-(r[3].toArray() @ beta[:-1] + beta[-1])))), r[2]) for r in rows if r[0] == name):
            if -s >= threshold and all(abs(t - k) >= distance for k in kept):
                kept.append(t)
        refs = sorted(t for r, t in truth if r == name)
        tp = events.match_count(sorted(kept), refs, 0.05)
        return tp, len(kept) - tp, len(refs) - tp

    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    for held in names:
        rated = []
        for th in thresholds:
            for d in distances:
                each = [counts(n, (held, n), th, d) for n in names if n != held]
                rated.append((-sum(f1(*c) for c in each) / 4, -min(f1(*c) for c in each), -f1(*map(sum, zip(*each, strict=True))), th, d))
        th, d = min(rated)[3:]
        assert got[held] == (th, d, *counts(held, (held,), th, d))
    assert len(got) == len(names) and learn.nested(df, reference, "logistic", thresholds, distances).count() == 5


def test_number_of_jobs_does_not_grow(spark, candidates):
    _, _, df, _ = candidates
    tracker = spark.sparkContext.statusTracker()

    def jobs(some, group):
        spark.sparkContext.setJobGroup(group, group)
        folds.fit(some, "least_squares")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(df.filter("recording_id < 'c'"), "two") == jobs(df, "five") > 0


def rings(spark, n=400):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        radius, angle = (1.0 if i % 2 else 3.0) + rng.normal(0, 0.15), rng.uniform(0, 2 * np.pi)
        rows.append((Vectors.dense([radius * np.cos(angle), radius * np.sin(angle)]), i % 2))
    return spark.createDataFrame(rows, ["features", "label"])


def test_kernel_machine_tells_rings_apart(spark, tmp_path):
    df = rings(spark)
    right = lambda model: learn.scores(model, df).filter("(score > 0) = (label = 1)").count() / df.count()
    model = learn.fit(df, "kernel_svm")
    assert right(model) > 0.98 and right(learn.fit(df, "linear_svm")) < 0.75
    learn.save(model, f"{tmp_path}/m", kind="kernel_svm")
    loaded, settings = learn.load(f"{tmp_path}/m")
    assert settings["kind"] == "kernel_svm"
    pick = lambda m: [r.score for r in learn.scores(m, df).select("score").collect()]
    assert pick(loaded) == pick(model)


def test_cosines_approach_the_kernel(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x], ["v"])
    out = np.array([r.c.toArray() for r in models.CosineFeatures(inputCol="v", outputCol="c", size=8000, gamma=0.3, seed=1).transform(df).collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(out @ out.T - want).max() < 0.06


def plain_forest(x, y, w, trees, depth, least, share, seed):
    """Each tree on its own, node by node, with the same draws."""
    low, high = x.min(axis=0), x.max(axis=0)
    k = max(1, int(np.ceil(share * x.shape[1])))
    out, gains = [], np.zeros(x.shape[1])
    for t in range(trees):
        nodes = [dict(rows=np.arange(len(x)), low=low, high=high, leaf=True)]
        level = [0]
        for _ in range(depth):
            later = []
            for i in level:
                node = nodes[i]
                features, cuts = models.draw(seed, t, i, node["low"], node["high"], k)
                best = None
                for f, c in zip(features, cuts, strict=True):
                    go = x[node["rows"], f] <= c
                    parts = [node["rows"], node["rows"][go], node["rows"][~go]]
                    if min(len(parts[1]), len(parts[2])) < least:
                        continue
                    whole, a, b = (float(models.gini(w[q][y[q] == 0].sum(), w[q][y[q] == 1].sum())) for q in parts)
                    if whole - a - b > 1e-12 and (best is None or whole - a - b > best[0] + 1e-9):
                        best = (whole - a - b, f, c, parts)
                if best is None:
                    continue
                gain, f, c, parts = best
                gains[f] += gain
                node.update(leaf=False, f=f, c=c, kids=[])
                for side, q in enumerate(parts[1:]):
                    lo, hi = node["low"].copy(), node["high"].copy()
                    (lo if side else hi)[f] = c
                    nodes.append(dict(rows=q, low=lo, high=hi, leaf=True))
                    node["kids"].append(len(nodes) - 1)
                    if len(q) >= 2 * least and 0 < y[q].sum() < len(q):
                        later.append(len(nodes) - 1)
            level = later
        out.append(nodes)

    def predict(v):
        total = 0.0
        for nodes in out:
            node = nodes[0]
            while not node["leaf"]:
                node = nodes[node["kids"][int(v[node["f"]] > node["c"])]]
            q = node["rows"]
            total += w[q][y[q] == 1].sum() / w[q].sum()
        return total / trees

    return predict, gains / gains.sum()


def test_random_cut_trees_equal_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(int)
    w = np.where(y == 1, 1.5, 0.5)
    df = spark.createDataFrame([(Vectors.dense(a), int(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], ["features", "label", "weight"]).repartition(5)
    model = models.RandomCutTrees(weightCol="weight", numTrees=8, maxDepth=5, leastLeaf=3, share=0.6, seed=11).fit(df)
    predict, importances = plain_forest(x, y, w, 8, 5, 3, 0.6, 11)
    assert model.getOrDefault(model.importances) == pytest.approx(importances.tolist(), abs=1e-9)
    for r in model.transform(df).collect():
        assert r.probability[1] == pytest.approx(predict(r.features.toArray()), abs=1e-9)
    fitted = learn.fit(df.drop("weight"), "random_cuts")
    learn.save(fitted, f"{tmp_path}/t")
    loaded, _ = learn.load(f"{tmp_path}/t")
    scores = [r.score for r in learn.scores(loaded, df.drop("weight")).collect()]
    assert scores == [r.score for r in learn.scores(fitted, df.drop("weight")).collect()]
    assert learn.scores(loaded, df.drop("weight")).filter("(score > 0.5) = (label = 1)").count() > 290
    assert importances[:2].sum() > 0.6
