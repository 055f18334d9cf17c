"""Jobs on files: ``python -m prosodia.cli JOB ...``. Every job reads folders and writes folders of any file system."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "recording_id string, word_idx int, word string, start double, end double, conf double"


def analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Waveforms, recognised words and transcripts to the tables of an analysis."""
    from prosodia.plans.analysis import analyse as run
    from prosodia.sources import files

    words = spark.read.schema(WORDS).json(a.words)
    texts = files.transcripts(spark, a.texts) if a.texts else spark.createDataFrame([], "recording_id string, text string")
    for name, table in run(words, files.waveforms(spark, a.audio), texts.select("recording_id", "text")).items():
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Analyses (all, or --recordings) against manual grids and word counts: tables, a text report and CSV with a byte order mark."""
    from prosodia.plans.evaluation import evaluate as run
    from prosodia.plans.evaluation import report
    from prosodia.sources import files, grids, sinks

    manual = grids.intervals(grids.read_grids(spark, a.grids), a.tier)
    own = files.analyses(spark, a.analyses)
    if a.recordings:
        own = own.filter(F.col("recording_id").isin(a.recordings))
    tables = run(own, manual, files.ground_truth(spark, a.truth))
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{a.out}/{name}")
    lines = report(tables).orderBy(F.asc_nulls_last("recording_id"), "position")
    lines.select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    if a.csv:
        sinks.write_csv_with_mark(tables["text_syllables"].orderBy(F.asc_nulls_last("recording_id")), a.csv)
    for r in lines.filter("recording_id is null").collect():  # a line a measure
        print(r.line)


def reduce(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reduction statistics over analyses; --pool names recordings that also count together."""
    from prosodia.plans import reduction
    from prosodia.sources import files, sinks

    rows = reduction.measures(files.analyses(spark, a.analyses))
    pooled = F.col("recording_id").isin(a.pool) if a.pool else None
    out = reduction.compare(rows, pooled, collapse=a.collapse)
    out.write.mode("overwrite").json(f"{a.out}/comparison")
    sinks.write_markdown(out, f"{a.out}/report", ["recording_id", "vowel", "position"])


def stress(spark: SparkSession, a: argparse.Namespace) -> None:
    """Agreement of dictionary and acoustic stress by syllable count."""
    from prosodia.operators import records, stats
    from prosodia.sources import files

    stats.stress_agreement(records.words(files.analyses(spark, a.analyses)), "recording_id", "stressed", "expected").write.mode("overwrite").json(a.out)


def recognisers(spark: SparkSession, a: argparse.Namespace) -> None:
    """Word error rates of JSON hypotheses (recording_id, engine, text) against transcripts."""
    from prosodia.plans.evaluation import recognisers as run
    from prosodia.sources import files

    hyp = spark.read.schema("recording_id string, engine string, text string").json(a.hypotheses)
    for name, table in run(files.transcripts(spark, a.texts).select("recording_id", "text"), hyp).items():
        table.write.mode("overwrite").json(f"{a.out}/{name}")


def detect(spark: SparkSession, a: argparse.Namespace) -> None:
    """Nuclei of waveforms."""
    from prosodia.functions.signal import PRODUCTION
    from prosodia.plans.analysis import candidates
    from prosodia.sources import files

    settings = load_settings(spark, a.settings) if a.settings else PRODUCTION
    candidates(files.waveforms(spark, a.audio), settings).write.mode("overwrite").json(a.out)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A model of nuclei from waveforms, encoder states (recording_id, frame, x) and reviewed points."""
    from prosodia.plans import consensus
    from prosodia.sources import files, grids

    points = grids.points(grids.read_grids(spark, a.grids), a.tier).select("recording_id", "t")
    consensus.train(files.waveforms(spark, a.audio), spark.read.parquet(a.states), points, a.out, a.kind)


def events(spark: SparkSession, a: argparse.Namespace) -> None:
    """Events of a trained model; recognised words prune what exceeds their vowels."""
    from prosodia.functions.text import vowel_count
    from prosodia.plans import consensus
    from prosodia.sources import files

    words = spark.read.schema(WORDS).json(a.words).withColumn("vowels", vowel_count(F.col("word"))) if a.words else None
    consensus.detect(files.waveforms(spark, a.audio), spark.read.parquet(a.states), a.model, words).write.mode("overwrite").json(a.out)


def stream(spark: SparkSession, a: argparse.Namespace) -> None:
    """Segments of encoder states (key, ts, frame, x) from files that came since the last run with this checkpoint."""
    from prosodia.streaming.windows import run_segments

    run_segments(spark, a.states, a.out, a.checkpoint, float(a.norm), float(a.merge))


def clips(spark: SparkSession, a: argparse.Namespace) -> None:
    """A wave file's bytes for each labelled interval of a tier."""
    from prosodia.sources import files, grids, sinks

    sinks.clips(files.waveforms(spark, a.audio), grids.intervals(grids.read_grids(spark, a.grids), a.tier), a.max).write.mode("overwrite").parquet(a.out)


def load_settings(spark: SparkSession, path: str):
    """Detector settings from JSON: the defaults with the overrides of its best entry, unknown ones ignored."""
    import json
    from dataclasses import fields

    from prosodia.functions.signal import Settings

    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.get("best", {}).get("overrides", {}).items() if k in known})


def with_lemmas(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words with lemma and part of speech from a table (word, lemma, pos, rank); the first parse counts, unknown words are null."""
    from prosodia.operators.ranking import top_per

    first = top_per(dictionary, ["word"], 1, F.col("rank")).select(F.col("word").alias("__w"), "lemma", "pos")
    return words.join(first, F.lower("word") == F.col("__w"), "left").drop("__w")


JOBS = {
    analyse: ["--audio", "--words", "--texts?", "--out"],
    evaluate: ["--analyses", "--grids", "--truth", "--tier=syllable", "--recordings*", "--csv?", "--out"],
    reduce: ["--analyses", "--pool*", "--collapse!", "--out"],
    stress: ["--analyses", "--out"],
    recognisers: ["--texts", "--hypotheses", "--out"],
    detect: ["--audio", "--settings?", "--out"],
    train: ["--audio", "--states", "--grids", "--tier=nucleus", "--kind=kernel_svm", "--out"],
    events: ["--audio", "--states", "--model", "--words?", "--out"],
    stream: ["--states", "--norm=2.6", "--merge=0.8", "--checkpoint", "--out"],
    clips: ["--audio", "--grids", "--tier=syllable", "--max#", "--out"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prosodia", description=__doc__)
    jobs = p.add_subparsers(required=True)
    for job, options in JOBS.items():
        own = jobs.add_parser(job.__name__, help=job.__doc__)
        own.set_defaults(job=job)
        for o in options:
            name, _, default = o.rstrip("?*!#").partition("=")
            if o.endswith("!"):
                own.add_argument(name, action="store_true")
            elif o.endswith("*"):
                own.add_argument(name, nargs="*", default=[])
            else:
                own.add_argument(name, required=not default and o[-1] not in "?#", default=default or None, type=int if o.endswith("#") else str)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.job(SparkSession.builder.appName("prosodia").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
