import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.functions import arrays, signal, text
from prosodia.operators import windows


@pytest.mark.parametrize("word", ["э-фир", "вос-про-из-вес-ти", "ви-де-о", "ор-га-ни-за-ци-и", "се-го-дня", "се-мья", "в", "мир"])
def test_syllables(word):
    assert text.split_syllables(word.replace("-", "")) == word.split("-")


def test_syllables_keep_case_and_letters():
    assert text.split_syllables("ВИДЕО") == ["ВИ", "ДЕ", "О"]
    for w in ("объезд", "ньюёрк", "подъём", "strange", ""):
        assert "".join(text.split_syllables(w)) == w
    assert text.split_syllables("banana", text.LATIN_VOWELS, text.LATIN_SONORITY, "") == ["ba", "na", "na"]


@pytest.mark.parametrize(("form", "units", "want"), [("молок+о", ["мо", "ло", "ко"], 2), ("молоко́", ["мо", "ло", "ко"], 2), ("проведём", ["про", "ве", "дём"], 2), ("слово", ["сло", "во"], -1), ("дом", ["дом"], 0), ("м+олоко́", ["мо", "ло", "ко"], 2)])
def test_stress_marks(form, units, want):
    assert text.stress_index(form, units) == want


def test_text_columns(spark):
    row = spark.createDataFrame([("Ёлка, по-русски é2!", ["мо", "л+о"], ["мо", "ло"], ["а+", "б+"])], "s string, a array<string>, b array<string>, c array<string>")
    got = row.select(
        text.spaced_words(F.col("s")).alias("spaced"), text.found_words(F.col("s")).alias("found"), text.clean_word(F.col("s")).alias("clean"),
        text.vowel_count(F.col("s")).alias("n"), text.main_vowel(F.col("s"), "ауи").alias("v"), text.main_vowel(F.lit("xyz")).alias("none"),
        text.manual_stress(F.col("a")).alias("m1"), text.manual_stress(F.col("b")).alias("m0"), text.manual_stress(F.col("c")).alias("m2"),
        text.grid_quote(F.lit('a "b"\nc')).alias("q"), text.clean_recognised(F.lit(" Дом-2! ")).alias("r"),
        text.nucleus_count(F.lit(None).cast("int"), F.lit("в"), F.lit(1)).alias("vowelless"), text.nucleus_count(F.lit(3), F.lit("в"), F.lit(1)).alias("stored"),
        text.span_bounds(F.array(F.lit("мо"), F.lit("локо"))).alias("spans"), text.hint("deletion", F.lit("ма")).alias("hint"), text.has_vowel(F.lit("стр")).alias("hv"),
    ).first()
    assert got.spaced == ["ёлка", "по", "русски", "é2"] and got.found == ["елка", "по-русски", "2"] and got.clean == "ёлкапорусски"
    assert (got.n, got.v, got.none) == (5, "а", None)
    assert (got.m1, got.m0, got.m2) == (1, None, None)
    assert got.q == 'a ""b"" c' and got.r == "дом-2" and (got.vowelless, got.stored) == (0, 3)
    assert [tuple(s) for s in got.spans] == [(0, 2), (2, 6)] and "ма" in got.hint and got.hv is False


def test_arrow_text(spark):
    df = spark.createDataFrame([("видео", "вид+ео"), (None, None)], "w string, a string")
    rows = df.select(text.syllables("w").alias("s"), text.stressed_syllable("a", text.syllables("w")).alias("i")).collect()
    assert rows[0].s == ["ви", "де", "о"] and rows[0].i == 1 and rows[1].i == -1


def test_student_and_beta():
    assert arrays.two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert arrays.two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert arrays.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-6)


def test_array_columns(spark):
    got = spark.range(1).select(
        arrays.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 4).alias("pad"), arrays.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 3, None).alias("edge"), arrays.fit_length(F.array(F.lit(1.0), F.lit(2.0)), 1).alias("cut"),
        arrays.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("cos"), arrays.centralization(F.lit(500.0), F.lit(1540.0)).alias("c"), arrays.centralization(F.lit(None).cast("double"), F.lit(1.0)).alias("none"),
        arrays.sigmoid(F.lit(0.0)).alias("s"), arrays.min_max_array(F.array(F.lit(3.0), F.lit(3.0))).alias("flat"), arrays.sorted_unique(F.array(F.lit(3), F.lit(1)), F.array(F.lit(3))).alias("u"), arrays.resampled(F.array(F.lit(0.0), F.lit(2.0)), F.lit(3)).alias("r"),
    ).first()
    assert got.pad == [1, 2, 0, 0] and got.edge == [1, 2, 2] and got.cut == [1] and got.cos == pytest.approx(1) and (got.c, got.none, got.s) == (40.0, -1.0, 0.5)
    assert got.flat == [0, 0] and got.u == [1, 3] and got.r == [0, 1, 2]


def bursts():
    t = np.arange(int(1.4 * 16000)) / 16000
    return sum(np.exp(-0.5 * ((t - c) / 0.055) ** 2) * sum(np.sin(2 * np.pi * f * k * t) / k for k in (1, 2, 3)) * 0.3 for c, f in ((0.30, 180), (0.70, 220), (1.10, 195)))


def test_nuclei_of_bursts_and_noise():
    found, tracks = signal.detect_nuclei(bursts(), 16000)
    assert np.allclose([c["time_seconds"] for c in found], [0.3, 0.7, 1.1], atol=0.06)
    assert abs(signal.best_time(tracks, 0.5, 0.9) - 0.7) < 0.1
    noise = np.zeros(16000)
    noise[4000:5200] = np.random.default_rng(7).normal(0, 0.3, 1200)
    assert signal.detect_nuclei(noise, 16000, signal.PRODUCTION.with_(strong_min_periodicity=0.95))[0] == []
    assert signal.detect_nuclei(np.zeros(16000), 16000)[0] == []
    assert signal.PRODUCTION.name == "recall_4_noise_gate" and len(signal.PRESETS) == 8


def test_word_kernels():
    x = bursts()
    syllables, clear = signal.analyse_word(x, 16000, ["ма", "ма", "ма"], 3)
    assert clear == 3 and len(syllables) == 3 and all(s["startSec"] < s["endSec"] for s in syllables)
    assert signal.acoustic_stress(syllables)[0] in (0, 1, 2) and signal.acoustic_stress(syllables[:1]) == (0, [1.0])
    f0, per = signal.pitch(np.sin(2 * np.pi * 150 * np.arange(16000) / 16000), 16000)
    assert np.median(f0[f0 > 0]) == pytest.approx(150, rel=0.02) and per.max() > 0.9
    assert signal.slice_median(np.array([0.0, 0.1, 0.2]), np.array([100.0, np.nan, 120.0]), 0.0, 0.2) == 100.0
    assert signal.boundaries(np.array([3.0, 1.0, 3.0]), [0, 2], 2)[0][1] == pytest.approx(0.01 + 0.01)
    assert signal.trim_bounds(np.zeros(0), 16000) == (0, 0) and signal.features(np.zeros(10), 16000) == {}


def test_formants_of_a_resonance():
    rng, rate = np.random.default_rng(0), 16000
    y = np.zeros(4000)
    e = rng.normal(size=4000)
    r, f = 0.97, 700
    for i in range(2, 4000):
        y[i] = e[i] + 2 * r * math.cos(2 * math.pi * f / rate) * y[i - 1] - r * r * y[i - 2]
    assert min(abs(v - 700) for v in signal.formants(y, rate)) < 80


def test_peaks():
    p, prom = signal.find_peaks(np.array([0, 2, 1, 3, 3, 0, 1, 0.0]), prominence=1.0)
    assert p.tolist() == [1, 3, 6] and prom.tolist() == [1, 3, 1]
    assert signal.find_peaks(np.array([0, 2, 0, 3, 0.0]), distance=3)[0].tolist() == [3]


def test_candidate_features():
    _, t = signal.detect_nuclei(bursts(), 16000)
    at = signal.candidate_pool(t)
    assert len(signal.candidate_matrix(t, at)) == len(at) > 3
    assert signal.segment_matrix(t, [(0.2, 0.4)]).shape == (1, 17)
    assert signal.soft_target(np.array([0.0, 0.025]), np.array([0.0])).tolist() == pytest.approx([1, math.exp(-0.5)])
    states = np.vstack([np.tile([3.0, 0], (5, 1)), np.zeros((2, 2)), np.tile([0, 3.0], (5, 1))])
    assert windows.segments_by_similarity(states, 1.0, 0.8) == [(0, 5), (7, 12)]
    assert signal.votes(states, [1.0, 2.0], [0.8]).argmax() in (2, 9)
    assert windows.deltas(np.arange(9.0))[4] == pytest.approx(1.0)
    assert windows.gaussian(np.ones(5), 1.0) == pytest.approx(np.ones(5))


def test_t_distribution_over_columns(spark):
    from pyspark.sql import functions as F

    rows = [(2.0, 10.0), (0.0, 3.0), (math.inf, 5.0), (-math.inf, 5.0), (None, 4.0), (1.0, None), (float("nan"), 2.0), (-12.0, 7.5)]
    out = [r.p for r in spark.createDataFrame(rows, "t double, df double").coalesce(1).select(arrays.student_p("t", "df").alias("p")).collect()]
    assert out[0] == pytest.approx(0.0733880, abs=1e-6) and out[1] == pytest.approx(1.0) and out[2] == out[3] == 0.0 and out[4:7] == [None] * 3 and 0 < out[7] < 1e-5
    # one degree of freedom has a closed form
    t = np.array([0.1, 1.0, 5.0])
    assert arrays.two_sided_p(t, np.ones(3)) == pytest.approx(1 - 2 / math.pi * np.arctan(t), abs=1e-6)
