"""Writers that show all files or none, readers that skip what a filter refuses, chunked clips, and segments as a stream."""

import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia import cli
from prosodia.operators import windows
from prosodia.sources import files, grids, sinks, stores
from prosodia.streaming import windows as sw

TIERS = [
    {"name": "syllable", "kind": "interval", "rows": [(0.0, 0.5, ""), (0.5, 1.0, 'a "q"'), (1.0, 2.0, "б")]},
    {"name": "nucleus", "kind": "point", "rows": [(0.7, 0.7, "N"), (1.2, 1.2, "?")]},
    {"name": "hint", "kind": "interval", "rows": [(0.0, 2.0, "x")]},
]


def rows_of(name):
    return [(name, t["name"], t["kind"], i, *r, 0.0, 2.0, k) for k, t in enumerate(TIERS) for i, r in enumerate(t["rows"])]


SCHEMA = grids.SCHEMA + ", tier_order int"


def test_grids_are_written_and_read_back(spark, tmp_path):
    names = [f"r{i}" for i in range(6)]
    df = spark.createDataFrame([r for n in names for r in rows_of(n)], SCHEMA).repartition(5, "start")
    out = f"file://{tmp_path}/grids"
    sinks.write_grids(df, out)
    assert sorted(os.listdir(tmp_path / "grids")) == [f"{n}.TextGrid" for n in names]
    grids.register(spark)
    back = spark.read.format("textgrid").load(out)
    assert back.exceptAll(df.drop("tier_order")).count() == 0 and back.count() == df.count()
    assert spark.read.format("textgrid").load(f"{tmp_path}/grids/r[12].TextGrid").select("recording_id").distinct().count() == 2
    with pytest.raises(Exception, match="FileExists|File exists|r\\d.TextGrid"):
        sinks.write_grids(df, out)
    assert sorted(os.listdir(tmp_path / "grids")) == [f"{n}.TextGrid" for n in names]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = [("bad", "syllable", "interval", 0, 0.0, 0.4, "", 0.0, 2.0, 0)]
    df = spark.createDataFrame([*rows_of("good"), *rows_of("other"), *bad], SCHEMA)
    with pytest.raises(Exception, match="gapless"):
        sinks.write_grids(df, f"{tmp_path}/g")
    assert not os.path.isdir(tmp_path / "g") or os.listdir(tmp_path / "g") == []


def test_one_file_from_two_tasks_is_refused(spark, tmp_path):
    grids.register(spark)
    df = spark.createDataFrame([r for r in rows_of("r") if r[1] == "nucleus"], SCHEMA).repartitionByRange(2, "start")
    with pytest.raises(Exception, match="share a partition"):
        df.write.format("textgrid").mode("append").save(f"{tmp_path}/two")
    assert os.listdir(tmp_path / "two") == []


def test_filters_skip_files_and_tiers(spark, tmp_path, monkeypatch):
    grids.register(spark)
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.TextGrid").write_text(grids.render(0.0, 2.0, TIERS))
    df = spark.read.format("textgrid").option("partitionBytes", "700").load(str(tmp_path))
    some = df.filter("tier = 'nucleus' and recording_id in ('a', 'c')")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "textgrid" in plan and "nucleus" not in plan  # the scan takes the conditions: no filter of Spark's holds them
    assert sorted((r.recording_id, r.text) for r in some.collect()) == [("a", "?"), ("a", "N"), ("c", "?"), ("c", "N")]
    assert df.filter("kind = 'point'").count() == 6 and df.filter("text = 'x'").count() == 3
    reader = grids.GridReader({"path": str(tmp_path), "partitionBytes": "700"})
    left = list(reader.pushFilters([grids.EqualTo(("tier",), "hint"), grids.In(("recording_id",), ("b", "c")), grids.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)]
    parts = reader.partitions()
    assert sorted(os.path.basename(p) for part in parts for p in part.paths) == ["b.TextGrid", "c.TextGrid"]
    read = []
    values = grids._values
    monkeypatch.setattr(grids, "_values", lambda body: read.append(body) or values(body))
    assert [r[1] for p in parts for r in reader.read(p)] == ["hint", "hint"]
    assert not any("syllable" in body for body in read)


def test_a_label_like_a_head_doesnt_mislead():
    odd = [{"name": "a", "kind": "interval", "rows": [(0.0, 1.0, "IntervalTier"), (1.0, 2.0, "TextTier")]}, {"name": "b", "kind": "point", "rows": [(0.5, 0.5, "x")]}]
    text = grids.render(0.0, 2.0, odd)
    assert grids.parse(text, lambda name, kind: name == "b")[2] == odd[1:] and grids.parse(text) == (0.0, 2.0, odd)
    short = 'File type = "ooTextFile"\n"TextGrid"\n0\n2\n<exists>\n2\n"IntervalTier"\n"a"\n0\n2\n1\n0\n2\n"TextTier"\n"TextTier"\n"b"\n0\n2\n1\n0.5\n"x"\n'
    assert grids.parse(short, lambda name, kind: kind == "point")[2] == grids.parse(short)[2][1:]


def test_marked_csv(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f'a,"{i}"\né', i / 2) for i in range(20)], "n int, s string, x double").repartition(3)
    sinks.write_csv_with_mark(df, f"{tmp_path}/folder")
    parts = sorted(os.listdir(tmp_path / "folder"))
    assert parts == ["part-00000.csv", "part-00001.csv", "part-00002.csv"]
    rows = []
    for p in parts:
        raw = (tmp_path / "folder" / p).read_bytes()
        assert raw.startswith(b"\xef\xbb\xbfn,s,x\n")
        rows += list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))[1:]
    assert sorted(rows) == sorted([str(i), "" if i % 3 else f'a,"{i}"\né', str(i / 2)] for i in range(20))
    sinks.write_csv_with_mark(df.orderBy("n"), f"{tmp_path}/one.csv")
    assert [r[0] for r in csv.reader(open(f"{tmp_path}/one.csv", encoding="utf-8-sig", newline=""))][1:] == [str(i) for i in range(20)]
    with pytest.raises(Exception, match="one.csv"):
        sinks.write_csv_with_mark(df, f"{tmp_path}/one.csv")
    assert stores.listed(str(tmp_path / "folder"), "*.csv") == [(str(tmp_path / "folder" / p), (tmp_path / "folder" / p).stat().st_size) for p in parts]


def test_manifest_and_report(spark, tmp_path):
    df = spark.createDataFrame([("r", 1)], "recording_id string, n int")
    sinks.write_candidates(df, df, f"{tmp_path}/m/")
    assert spark.read.json(f"{tmp_path}/m/candidates").count() == spark.read.json(f"{tmp_path}/m/manifest").count() == 1
    sinks.write_markdown(df, f"{tmp_path}/report", ["recording_id"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["| recording_id | n |", "|---|---|", "| r | 1 |"]


def test_clips_of_chunks_equal_clips_of_whole_signals(spark):
    rng = np.random.default_rng(1)
    signals = {"a": rng.uniform(-1, 1, 3 * files.RATE + 77), "b": rng.uniform(-1, 1, files.RATE), "empty": np.zeros(0)}
    waves = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "recording_id string, samples array<float>")
    spans = [("a", 0.0, 0.3), ("a", 0.45, 0.55), ("a", 0.9, 2.7), ("a", 2.9, 9.0), ("a", 5.0, 6.0), ("b", 0.5, 1.0), ("b", 0.2, 0.2), ("empty", 0.0, 1.0), ("none", 0.0, 1.0)]
    iv = spark.createDataFrame([(*s, f"{s[1]}") for s in spans], "recording_id string, start double, end double, text string")
    want = {}
    for name in signals:
        for n, (_, a, b) in enumerate(sorted(s for s in spans if s[0] == name), 1):
            part = signals[name][int(np.floor(a * files.RATE)) : int(np.ceil(b * files.RATE))]
            if len(part) > 50:
                want[name, n] = files.encode_wave(part.astype(np.float32))
    for table in (waves, sinks.chunks(waves, 0.5)):
        for limit in (sinks.BROADCAST, 0):
            sinks.BROADCAST, was = limit, sinks.BROADCAST
            try:
                got = {(r.recording_id, r.number): bytes(r.wav) for r in sinks.clips(table, iv, seconds=0.5).collect()}
            finally:
                sinks.BROADCAST = was
            assert got == want and len(want) == 5
    assert sinks.clips(waves, iv, most=1).count() == 1  # the first of b is empty


def frames(rng, n):
    kinds = np.array([[3.0, 0, 0], [0, 3.0, 0], [0, 0, 3.0], [0, 0, 0]])
    out = []
    while len(out) < n:
        k = rng.integers(4)
        out += [(kinds[k] + rng.normal(0, 0.1, 3)).tolist() for _ in range(rng.integers(1, 9))]
    return out[:n]


def test_segments_as_a_stream_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(key, i, x) for key in ("p", "q", "r") for i, x in enumerate(frames(rng, 90))]
    rows += [("s", i, [3.0, 0.0, 0.0]) for i in range(200)]  # one segment that nothing but time closes
    df = spark.createDataFrame(rows, "key string, frame long, x array<double>").withColumn("ts", F.timestamp_millis(F.col("frame") * 20 + 1_000_000)).select("key", "ts", "frame", "x")
    want = sorted((r.key, r.first, r.last) for r in windows.similarity_segments(df, "key", "frame", "x", 1.0, 0.8).collect())
    folder, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(folder)

    # rows of a file come in no order; files overlap in time by less than the allowed lateness
    cut = (F.col("frame") + F.pmod(F.xxhash64("key", "frame"), F.lit(15))) < 60
    arrive(df.filter(cut).orderBy(F.desc("frame")))
    sw.run_segments(spark, folder, out, mark, 1.0, 0.8, late="1 second", idle="600 milliseconds")
    first = spark.read.schema("key string, first long, last long, frames long").parquet(out).count()
    assert 0 < first < len(want)
    # stopped and started again: the open segments are still there
    arrive(df.filter(~cut).orderBy(F.rand(1)))
    sw.run_segments(spark, folder, out, mark, 1.0, 0.8, late="1 second", idle="600 milliseconds")
    # a row that moves the watermark far on, and one that is too late
    later = spark.createDataFrame([("z", 0, [0.0, 0.0, 0.0])], "key string, frame long, x array<double>").select("key", F.timestamp_millis(F.lit(9_000_000)).alias("ts"), "frame", "x")
    arrive(later)
    sw.run_segments(spark, folder, out, mark, 1.0, 0.8, late="1 second", idle="600 milliseconds")
    late = df.filter("key = 'p' and frame = 3").withColumn("x", F.array(*[F.lit(v) for v in (3.0, 3.0, 3.0)]))
    arrive(late)
    sw.run_segments(spark, folder, out, mark, 1.0, 0.8, late="1 second", idle="600 milliseconds")
    got = spark.read.parquet(out).collect()
    assert sorted((r.key, r.first, r.last) for r in got) == want and all(r.frames == r.last - r.first for r in got)


def test_stream_job(spark, tmp_path):
    df = spark.createDataFrame([("p", i, [3.0, 0.0] if i < 5 else [0.0, 3.0]) for i in range(400)], "key string, frame long, x array<double>")
    df.withColumn("ts", F.timestamp_millis(F.col("frame") * 20 + 1_000_000)).write.parquet(f"{tmp_path}/in")
    a = cli.parser().parse_args(["stream", "--states", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/c"])
    a.job(spark, a)
    assert [(r.first, r.last) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(0, 5)]
