"""Evaluation of analyses against manual annotation, and of recognisers against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.functions import text
from prosodia.operators import align, intervals, records, stats


def evaluate(analyses: DataFrame, manual: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Accuracy per recording and pooled, boundary errors, and stress agreement.

    manual: recording_id, start, end, text of manual syllables. truth: recording_id, word_idx, word, n.
    Manual syllables go to words in order by their counts; words of both sides are aligned.
    """
    key = "recording_id"
    dealt = intervals.allocate_positions(manual, truth, key, "start", "word_idx", "n")
    ground = dealt.groupBy(key, "word_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("sylls")).join(truth, [key, "word_idx"])
    ground = ground.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "n", "sylls"))).alias("g"))
    w = records.words(analyses)
    s = records.syllables(w).groupBy(key, "word_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("syllable").alias("text")))).alias("sylls"))
    own = w.join(s, [key, "word_idx"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "syllable_count", F.col("detectedNuclei").alias("nuclei"), "stressed", "expected", "sylls"))).alias("s"))
    pairs = own.join(ground, key).withColumn("a", F.explode(align.aligned(F.transform("s", lambda x: x["word"]), F.transform("g", lambda x: x["word"])))).filter("a.system_idx is not null and a.ground_idx is not null")
    p = pairs.select(key, F.get("s", F.col("a.system_idx")).alias("x"), F.get("g", F.col("a.ground_idx")).alias("y"))
    marked = text.manual_stress(F.transform("y.sylls", lambda v: v["text"]))
    p = p.withColumn("manual_stress", marked)
    boundary = stats.boundary_errors(p.withColumn("f", F.col("x.sylls")).withColumn("t", F.col("y.sylls")), [key], "f", "t")
    known = p.filter("x.stressed >= 0 and x.expected >= 0 and x.syllable_count > 1")
    return {
        "text_syllables": stats.accuracy(p, key, F.col("x.syllable_count") == F.col("y.n")),
        "nuclei": stats.accuracy(p, key, F.col("x.nuclei") == F.col("y.n")),
        "boundaries": boundary.rollup(key).agg(F.avg("error_ms").alias("mean_ms"), F.median("error_ms").alias("median_ms"), stats.p90("error_ms").alias("p90_ms"), F.count("*").alias("n")),
        "stress": stats.accuracy(known, key, F.col("x.stressed") == F.col("x.expected")),
        "manual_stress": stats.accuracy(p.filter("manual_stress is not null"), key, F.col("x.stressed") == F.col("manual_stress")),
    }


#: What the report says of each table, in order; shares are hits, total and percentage.
LINES = (
    ("text_syllables", "syllables of the text: %d/%d = %.1f%%"),
    ("nuclei", "acoustic nuclei: %d/%d = %.1f%%"),
    ("boundaries", "boundary error: mean %.1f ms, median %.1f ms, P90 %.1f ms (n=%d)"),
    ("stress", "acoustic against dictionary stress: %d/%d = %.1f%% (no ground truth)"),
    ("manual_stress", "acoustic stress against marks: %d/%d = %.1f%%"),
)
NO_MARKS = "acoustic stress against marks: — (no marks)"


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """recording_id (null: all), position, line of the evaluation as text: no measure is mixed with another.

    A recording with words has a heading and a line for each measure that it has; the one of stress marks says so where
    there are none. Pooled lines count hits and errors, not percentages.
    """
    key = "recording_id"
    known = tables["text_syllables"].filter("total > 0")
    names = known.select(key, F.col("total").cast("long").alias("total"))
    recordings = known.agg(F.count(key)).first()[0]
    heads = names.select(key, F.lit(0).alias("position"), F.when(F.col(key).isNull(), F.format_string("all %d recordings, %d words", F.lit(recordings), F.col("total"))).otherwise(F.format_string("[%s] %d words", F.col(key), F.col("total"))).alias("line"))
    out = heads
    for position, (name, line) in enumerate(LINES, 1):
        values = ("mean_ms", "median_ms", "p90_ms", "n") if name == "boundaries" else ("hits", "total", "accuracy")
        own = tables[name].filter("n > 0" if name == "boundaries" else "total > 0")
        out = out.unionByName(own.select(key, F.lit(position).alias("position"), F.format_string("  " + line, *[F.col(v) for v in values]).alias("line")))
    marked = tables["manual_stress"].filter("total > 0").select(F.col(key).alias("__k"))
    bare = names.join(marked, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return out.unionByName(bare.select(key, F.lit(len(LINES)).alias("position"), F.lit("  " + NO_MARKS).alias("line")))


def recognisers(references: DataFrame, hypotheses: DataFrame) -> dict[str, DataFrame]:
    """Word errors per recording and engine, and pooled by engine. Both sides: recording_id, text; hypotheses: engine."""
    j = hypotheses.join(references.withColumnRenamed("text", "__ref"), "recording_id")
    w = j.select("recording_id", "engine", text.found_words(F.col("__ref")).alias("r"), text.found_words(F.col("text")).alias("h"))
    rows = w.select("recording_id", "engine", F.size("r").alias("words"), align.edits("r", "h").alias("e")).select("recording_id", "engine", "words", "e.*")
    return {"rows": stats.wer(rows, "recording_id", "engine"), "aggregate": stats.wer(rows, "engine")}
