import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.functions import signal
from prosodia.operators import records
from prosodia.plans import analysis, detection, evaluation, learn, reduction
from prosodia.sources import files, grids, sinks
from tests.test_functions import bursts

TIERS = [
    {"name": "syllable", "kind": "interval", "rows": [(0.0, 0.5, ""), (0.5, 1.0, 'a "q"'), (1.0, 2.0, "б")]},
    {"name": "nucleus", "kind": "point", "rows": [(0.7, 0.7, "N"), (1.2, 1.2, "?")]},
]


def test_grid_round_trip(spark, tmp_path):
    text = grids.render(0.0, 2.0, TIERS)
    assert grids.parse(text) == (0.0, 2.0, TIERS)
    (tmp_path / "one.TextGrid").write_text(text, encoding="utf-8")
    (tmp_path / "two.TextGrid").write_bytes(text.encode("utf-16"))
    (tmp_path / "three.TextGrid").write_text(text, encoding="utf-8-sig")
    grids.register(spark)
    a = spark.read.format("textgrid").load(str(tmp_path))
    b = grids.read_grids(spark, str(tmp_path))
    assert a.count() == b.count() == 15 and a.exceptAll(b).count() == 0
    assert grids.intervals(b, "syllable").filter("recording_id = 'two'").count() == 2 and grids.intervals(b, "syllable", include_empty=True).count() == 9
    assert records.confirmed(grids.points(b, "nucleus")).count() == 3 and grids.flat_intervals(b).count() == 6
    with pytest.raises(Exception, match="holds intervals"):
        grids.points(b, "syllable").collect()
    assert grids.bounds(b).first().xmax == 2.0
    order = b.withColumn("tier_order", (F.col("tier") == "nucleus").cast("int"))
    assert {grids.parse(r.content) == (0.0, 2.0, TIERS) for r in grids.to_grids(order).collect()} == {True}
    sinks.write_grids(order, str(tmp_path / "out"))
    chunk = sinks.review_chunk(b.filter("recording_id = 'one'"), 0.6, 1.1)
    assert sorted((r.tier, round(r.start, 3), round(r.end, 3)) for r in chunk.collect()) == [("nucleus", 0.1, 0.1), ("syllable", 0.0, 0.4), ("syllable", 0.4, 0.5)]


def test_grid_refusals(tmp_path):
    for tier in ({"name": "p", "kind": "point", "rows": [(9.0, 9.0, "x")]}, {"name": "i", "kind": "interval", "rows": [(0.0, 1.0, "")]}, {"name": "i", "kind": "interval", "rows": [(0.0, 1.5, ""), (1.0, 2.0, "")]}):
        with pytest.raises(ValueError):
            grids.render(0.0, 2.0, [tier])
    with pytest.raises(ValueError):
        grids.render(0.0, 2.0, [TIERS[1], TIERS[1]])
    with pytest.raises(ValueError):
        grids.parse("no grid")
    sinks.blank_grid(0.0, 2.0, "nucleus", str(tmp_path / "b.TextGrid"))
    assert grids.parse((tmp_path / "b.TextGrid").read_text())[2][0]["rows"] == []
    with pytest.raises(FileExistsError):
        sinks.blank_grid(0.0, 2.0, "nucleus", str(tmp_path / "b.TextGrid"))


def test_waveforms_and_clips(spark, tmp_path):
    x = bursts()
    (tmp_path / "r.wav").write_bytes(files.encode_wave(x))
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.zeros(1600, dtype="<i2").tobytes())
    rows = {r.recording_id: r for r in files.waveforms(spark, str(tmp_path)).collect()}
    assert rows["r"].ready and np.allclose(rows["r"].samples, np.clip(x, -1, 1), atol=1e-3)
    assert not rows["stereo"].ready and len(rows["stereo"].samples) == 1600 and rows["bad"].samples is None and rows["bad"].error
    assert len(rows["r"].fingerprint) == 16
    iv = spark.createDataFrame([("r", 0.0, 0.2, "a"), ("r", 0.2, 0.4, "b"), ("r", 0.4, 0.4, "tiny")], "recording_id string, start double, end double, text string")
    clips = sinks.clips(files.waveforms(spark, str(tmp_path)), iv).collect()
    assert [(c.number, c.label) for c in sorted(clips)] == [(1, "a"), (2, "b")] and files.ready_wave(clips[0].wav)
    assert sinks.clips(files.waveforms(spark, str(tmp_path)), iv, most=1).count() == 1
    paths = spark.createDataFrame([("/x/a.mp3",), ("/x/a.wav",), ("/x/b.ogg",), ("/x/b.txt",)], "path string")
    assert sorted(r.path for r in files.preferred_audio(paths).collect()) == ["/x/a.wav", "/x/b.ogg"]


def syllable(name, start, end, dur, energy, central, core=None):
    c = None if core is None else {"duration": core, "energyMean": energy, "formants": [500.0, 1500.0], "central": central, "startInSyl": 0.01, "endInSyl": 0.01 + core}
    return {"syllable": name, "startSec": start, "endSec": end, "acoustics": {"mfcc": [1.0], "energyMean": energy, "zcrMean": 0.1, "formants": [400.0, 1400.0], "central": central, "duration": dur, "core": c}, "isProblematic": False, "remarks": []}


def record(n=12):
    words = []
    for i in range(n):
        words.append({"word": "мама", "start": i * 1.0, "end": i * 1.0 + 0.5, "confidence": 0.9, "syllableCount": 2, "textNucleusCount": 2, "detectedNuclei": 2, "countMismatch": False, "stressedIdx": 0, "expectedStressedIdx": 0, "actualStressedIdx": 0, "syllableAnalysis": [syllable("ма", 0.0, 0.3, 0.3 + 0.001 * i, 0.02, 300.0, 0.2 + 0.001 * i), syllable("ма", 0.3, 0.5, 0.2, 0.01, 150.0 + i, 0.1 + 0.001 * i)], "hasIssue": False})
    return {"audioFile": "r.wav", "wordAnalysis": words}


def test_records_and_reduction(spark, tmp_path):
    (tmp_path / "r_syllable_analysis.json").write_text(json.dumps(record(), ensure_ascii=False, indent=1))
    (tmp_path / "old_syllable_analysis.json").write_text(json.dumps({"wordAnalysis": [{"word": "в", "start": 0.0, "end": 0.1, "syllableAnalysis": []}]}))
    a = files.analyses(spark, str(tmp_path))
    w = records.words(a)
    s = records.syllables(w)
    assert s.count() == 24 and s.filter("position = 'posttonic'").first().start == pytest.approx(0.3)
    out = reduction.compare(reduction.measures(a), pooled=F.col("recording_id") == "r").collect()
    assert {r.recording_id for r in out} == {"r", "nonnative_pooled"} and {r.verdict for r in out} == {"strong"}
    assert out[0].position == "posttonic" and out[0].duration_ratio == pytest.approx(0.51, abs=0.01)
    assert reduction.forest(reduction.compare(reduction.measures(a))).count() == 1 and reduction.boxes(reduction.measures(a)).count() == 2
    rates = spark.createDataFrame([("r", 3.0), ("old", 0.0)], "recording_id string, rate double")
    sc = {r.recording_id: r for r in records.scores(w, s, rates).collect()}
    assert (sc["r"].stress_match, sc["r"].speech_tempo, sc["r"].syllable_acoustics, sc["r"].vowel_reduction) == (100.0, 100.0, 100.0, 100.0)
    assert sc["old"].stress_match is None and sc["old"].vowel_reduction is None and sc["old"].speech_tempo is None
    assert {r.recording_id: (r.words, r.good_words) for r in records.summary(w).collect()} == {"r": (12, 12), "old": (1, 1)}
    assert records.word_plot(w).filter("layer = 'core' and word_idx = 0").orderBy("start").first().start == pytest.approx(0.01)
    assert records.formant_points(w).count() == 24
    sinks.write_records(a, str(tmp_path / "json"))
    assert spark.read.schema(records.RECORD).json(str(tmp_path / "json")).count() == 2


def test_evaluation(spark, tmp_path):
    (tmp_path / "r_syllable_analysis.json").write_text(json.dumps(record(2)))
    a = files.analyses(spark, str(tmp_path))
    manual = spark.createDataFrame([("r", 0.0, 0.31, "м+а"), ("r", 0.31, 0.5, "ма"), ("r", 1.0, 1.3, "ма"), ("r", 1.3, 1.6, "ма")], "recording_id string, start double, end double, text string")
    (tmp_path / "truth.js").write_text(json.dumps({"_note": "x", "r": [["мама", 2], ["мама", 2], ["ещё", 2]]}, ensure_ascii=False))
    truth = files.ground_truth(spark, str(tmp_path / "truth.js"))
    assert truth.count() == 3
    e = evaluation.evaluate(a, manual, truth)
    assert [(r.hits, r.total) for r in e["text_syllables"].filter("recording_id is not null").collect()] == [(2, 2)]
    b = e["boundaries"].first()
    assert b.mean_ms == pytest.approx((10 + 100) / 6) and b.p90_ms == pytest.approx(100)
    assert [(r.hits, r.total) for r in e["manual_stress"].filter("recording_id is null").collect()] == [(1, 1)]
    lines = [r.line for r in evaluation.report(e).orderBy(F.asc_nulls_last("recording_id"), "position").collect()]
    assert lines[0] == "[r] 2 words" and lines[1] == "  syllables of the text: 2/2 = 100.0%" and lines[len(lines) // 2] == "all 1 recordings, 2 words"
    assert any(x.startswith("  boundary error: mean 18.3 ms") and x.endswith("P90 100.0 ms (n=6)") for x in lines) and sum("against marks: 1/1" in x for x in lines) == 2
    bare = evaluation.report({**e, "manual_stress": e["manual_stress"].filter("false")})
    assert bare.filter("line like '%no marks%'").count() == 2
    ref = spark.createDataFrame([("r", "один два три")], "recording_id string, text string")
    hyp = spark.createDataFrame([("r", "v", "один четыре пять"), ("r", "w", "один два три")], "recording_id string, engine string, text string")
    assert {r.engine: r.wer for r in evaluation.recognisers(ref, hyp)["aggregate"].collect()} == {"v": 66.67, "w": 0.0}
    assert files.common(ref, hyp).count() == 1 and files.missing(ref, hyp.filter("false")).first().missing == 0
    path = str(tmp_path / "t.csv")
    sinks.write_csv_with_mark(e["text_syllables"].orderBy("recording_id"), path)
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    lines = [r.line for r in sinks.markdown(ref.withColumn("n", F.lit(None).cast("int")), ["recording_id"]).collect()]
    assert lines == ["| recording_id | text | n |", "|---|---|---|", "| r | один два три | — |"]


def test_analysis_run(spark):
    waves = spark.createDataFrame([("r", [float(v) for v in bursts()]), ("none", None)], "recording_id string, samples array<float>")
    words = spark.createDataFrame([("r", 0, "ма", 0.2, 0.45, 0.9), ("r", 1, "мама", 0.55, 1.3, 0.5), ("r", 2, "а", 3.5, 3.51, 0.8)], "recording_id string, word_idx int, word string, start double, end double, conf double")
    refs = spark.createDataFrame([("r", "ма мама")], "recording_id string, text string")
    out = analysis.analyse(words, waves, refs)
    w = {r.word_idx: r for r in out["words"].collect()}
    assert w[0].nuclei_v2 == 1 and w[1].nuclei_v2 == 2 and w[1].text_nuclei == 2 and len(w[1].syllables) == 2
    assert [(r.after, r.before, r.duration) for r in out["pauses"].collect()] == [("мама", "а", 2.2)]
    c = out["comparison"].first()
    assert c.mode == "prompted" and c.word_accuracy == 1.0 and c["diff"].inserted == ["а"]
    free = analysis.analyse(words, waves, refs.filter("false"))["comparison"].first()
    assert free.mode == "free" and free.word_accuracy is None
    assert out["diagnostics"].first().low_confidence_word_count == 1 and out["nuclei_diagnostics"].first().unassigned == 0
    assert analysis.frame_tracks(waves).count() > 100


def test_detection(spark):
    ev = spark.createDataFrame([("r", 0, 0.10, 0.9), ("r", 1, 0.12, 0.5), ("r", 2, 0.60, -0.5)], "recording_id string, event_id long, t double, score double")
    nu = spark.createDataFrame([("r", 0, 0.11, 0.5), ("r", 1, 0.40, 0.5)], "recording_id string, event_id long, t double, confidence double")
    d = detection.fuse(ev, nu, 0.0, 0.05)
    assert sorted((r.t, r.origin, round(r.score, 2)) for r in d.collect()) == [(0.10, "candidate", 0.9), (0.40, "rescued", -0.94)]
    words = spark.createDataFrame([("r", 0, 0.3, 0.5, 0)], "recording_id string, word_idx int, start double, end double, vowels int")
    row = detection.describe(detection.prune(d, words)).first()
    assert (row.times_seconds, row.pruned_times_seconds, row.rescued_times_seconds) == ([0.10], [0.40], [])


def test_learning(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(0)
    rows = [(f"r{r}", k, k * 0.2, Vectors.dense([float(k % 2) + rng.normal(0, 0.1), rng.normal()]), float(k % 2)) for r in range(3) for k in range(20)]
    df = spark.createDataFrame(rows, ["recording_id", "event_id", "t", "features", "label"])
    ref = df.filter("label = 1").select("recording_id", "t")
    out = learn.nested(df, ref, "logistic", [0.4, 0.5], [0.05])
    assert out.agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first() == (30, 0, 0)
    model = learn.fit(df, "linear_svm")
    learn.save(model, str(tmp_path / "m"), threshold=0.5)
    loaded, settings = learn.load(str(tmp_path / "m"))
    assert settings["threshold"] == 0.5 and learn.scores(loaded, df).filter("score > 0").count() == 30
    for kind in ("forest", "boosted"):
        assert learn.scores(learn.fit(df, kind), df).filter("(score > 0.5) = (label = 1)").count() == 60
    assert signal.describe(signal.PRODUCTION)["name"] == signal.PRODUCTION.name


def test_streams(spark, tmp_path):
    from prosodia.streaming import windows as sw

    rows = [("r", float(i) * 0.1 + (5 if i > 5 else 0), float(i)) for i in range(12)]
    batch = spark.createDataFrame(rows, "k string, s double, v double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long"))).select("k", "ts", "v")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    for f, name in ((sw.tumbling, "tumbling"), (sw.hopping, "hopping")):
        assert run(f(stream, "k", "ts", "v"), name).exceptAll(f(batch, "k", "ts", "v")).count() == 0
    assert sorted(r.n for r in run(sw.phrases(stream, "k", "ts"), "phrases").collect()) == [6, 6]
    iv = batch.filter("v = 3").select("k", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 150 milliseconds")).alias("b"))
    assert sw.assign(batch, iv, "k", "ts", "a", "b").count() == 3


def test_scores_do_not_hang_on_the_order_of_rows(spark):
    # the mean ratio lies at a tie of the first decimal, and plain sums of doubles fall on either side of it
    stressed, other = [0.135, 0.2, 0.145], [0.135, 0.205, 0.115, 0.205]
    rows = [("r", 0, 0, "ба", d, p, 1, 1, 2, 0.1, True) for p, v in (("stressed", stressed), ("pretonic", other)) for d in v]
    schema = "recording_id string, word_idx int, syl_idx int, syllable string, duration double, position string, stressed int, expected int, syllable_count int, energy double, is_core boolean"
    found = set()
    for order in (rows, rows[::-1]):
        s = spark.createDataFrame(order, schema).coalesce(1)
        w = s.limit(1).withColumn("countMismatch", F.lit(False))
        found.add(records.scores(w, s, w.select("recording_id", F.lit(3.0).alias("rate"))).first().vowel_reduction)
    assert len(found) == 1
    x = spark.createDataFrame([(float("nan"),), (1e300,), (1.0,)], "x double")
    mean = lambda df: df.agg(records.steady_mean(F.col("x")).alias("m")).first().m
    assert mean(x.filter("x = 1")) == 1.0 and mean(x.filter("x < 1e301")) == (1e300 + 1.0) / 2 and mean(x) != mean(x) and mean(x.limit(0)) is None
