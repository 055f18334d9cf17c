"""The consensus job from tables to events, and its joined features against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.functions import signal
from prosodia.operators import windows
from prosodia.plans import consensus, learn

RATE = 16000
CENTRES = {"a": (0.3, 0.7, 1.1), "b": (0.25, 0.6, 0.95, 1.2), "c": (0.4, 0.8, 1.15), "d": (0.35, 0.75, 1.05)}


def sound(centres, rng):
    t = np.arange(int(1.5 * RATE)) / RATE
    x = sum(np.exp(-(((t - c) / 0.05) ** 2) / 2) * sum(np.sin(2 * np.pi * f * k * t) / k for k in (1, 2, 3)) for c, f in zip(centres, (180, 220, 195, 205), strict=False))
    return (0.3 * x + rng.normal(0, 0.002, len(t))).astype(float)


def encoded(centres, rng):
    out = []
    for i in range(75):
        near = [k for k, c in enumerate(centres) if abs((i + 0.5) / 50 - c) < 0.07]
        x = rng.normal(0, 0.05, 4)
        if near:
            x[near[0] % 4] += 3.2
        out.append(x.tolist())
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    waves = spark.createDataFrame([(r, sound(c, rng).tolist()) for r, c in CENTRES.items()], "recording_id string, samples array<float>")
    states = spark.createDataFrame([(r, i, x) for r, c in CENTRES.items() for i, x in enumerate(encoded(c, rng))], "recording_id string, frame long, x array<double>")
    truth = spark.createDataFrame([(r, t) for r, c in CENTRES.items() for t in c], "recording_id string, t double")
    return waves.cache(), states.cache(), truth


def test_joined_features_equal_loops(spark, tables):
    _, states, _ = tables
    rng = np.random.default_rng(2)
    at = [("a", i, float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 1.4, 25)))] + [("none", 0, 0.5)]
    events = spark.createDataFrame(at, "recording_id string, event_id long, t double")
    norms, merges = [1.0, 2.5], [0.7, 0.9]
    x = np.array([r.x for r in states.filter("recording_id = 'a'").orderBy("frame").collect()])
    middle = {(a, b): [(s + e) / 2 / 50 for s, e in windows.segments_by_similarity(x, a, b)] for a in norms for b in merges}
    got = {(r.recording_id, r.event_id): r.votes for r in consensus.vote_features(events, consensus.middles(states, norms, merges), norms, merges).collect()}
    shifts = [k * signal.HOP for k in signal.OFFSETS]
    w = lambda d: math.exp(-(d**2) / (2 * consensus.VOTE**2))
    for _, i, t in at[:-1]:
        met = {k: [m - t for m in v if abs(m - t) <= consensus.REACH] for k, v in middle.items()}
        curve = [sum(w(d - s) for v in met.values() for d in v) for s in shifts]
        own = lambda keep: sum(w(d) for k, v in met.items() if keep(k) for d in v if abs(d) <= 0.1)  # noqa: B023, E731
        nearest = sorted(min((abs(d) for d in v), default=consensus.REACH) for v in met.values())
        want = [*curve, *(own(lambda k, n=n: k[0] == n) for n in norms), *(own(lambda k, m=m: k[1] == m) for m in merges)]
        want += [sum(d <= r for d in nearest) / 4 for r in (0.020, 0.035, 0.050)]
        want += [max(0.0, curve[4] - max(min(curve[:5]), min(curve[4:]))), float(np.median(nearest)), float(np.std(nearest))]
        if ("a", i) in got:
            assert got["a", i] == pytest.approx(want, abs=1e-9)
        else:
            assert not any(met.values())
    assert ("none", 0) not in got
    context = {r.event_id: r.context for r in consensus.state_features(events.filter("recording_id = 'a'"), states).collect()}
    for _, i, t in at[:-1]:
        k = math.floor(t * 50 + 0.5)
        around = [x[j] for j in range(k - 3, k + 4) if 0 <= j < len(x)]
        size = [math.sqrt(v @ v + 1e-8) for v in around]
        assert context[i][:3] == pytest.approx([math.sqrt(x[k] @ x[k] + 1e-8), np.mean(size), np.std(size)])


@pytest.mark.parametrize("kind", ["logistic", "kernel_svm"])
def test_from_tables_to_events(spark, tables, tmp_path, kind):
    waves, states, truth = tables
    learnt = F.col("recording_id") != "d"
    settings = consensus.train(waves.filter(learnt), states.filter(learnt), truth.filter(learnt), f"{tmp_path}/m", kind)
    assert settings["kind"] == kind and learn.load(f"{tmp_path}/m")[1]["threshold"] == settings["threshold"]
    out = consensus.detect(waves.filter("recording_id = 'd'"), states, f"{tmp_path}/m").collect()
    assert [r.recording_id for r in out] == ["d"]
    times = out[0].times_seconds
    assert len(times) == len(out[0].event_scores) and all(min(abs(t - c) for t in times) <= 0.05 for c in CENTRES["d"]) and len(times) <= 5
    words = spark.createDataFrame([("d", 0, 0.2, 0.5, 1), ("d", 1, 0.6, 1.2, 2)], "recording_id string, word_idx int, start double, end double, vowels int")
    pruned = consensus.detect(waves.filter("recording_id = 'd'"), states, f"{tmp_path}/m", words, slack=0).first()
    assert len(pruned.times_seconds) + len(pruned.pruned_times_seconds) == len(times) and len(pruned.times_seconds) <= len(times)
