"""Analysis of recordings: recognised words and waveforms to nested records, and the report tables.

Signals are decoded and analysed a recording at a time (grouped map); everything after that is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.functions import pitch, signal, text
from prosodia.operators import align, intervals, records, stats, windows
from prosodia.sources.files import RATE

CANDIDATES = "recording_id string, candidate_id int, t double, confidence double, prominence double, strength double, periodicity double, vowel_likeness double, sonorant_penalty double, weak_recovery boolean"
FRAMES = "recording_id string, frame int, t double, envelope double, likelihood double, periodicity double, vowel double, f0 double"
WORD = "recording_id string, word_idx int, syllables array<struct<syllable:string,startSec:double,endSec:double,isProblematic:boolean,remarks:array<string>,duration:double,energyMean:double,central:double,core_duration:double,core_energy:double,core_central:double,f0:double>>, detected int, stressed int"


def candidates(waveforms: DataFrame, settings: signal.Settings = signal.PRODUCTION) -> DataFrame:
    """Nuclei of whole signals, before any word is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, samples in zip(pdf["recording_id"], pdf["samples"], strict=True):
                found, _ = signal.detect_nuclei(np.asarray(samples), RATE, settings)
                yield pd.DataFrame([(rec, i, c["time_seconds"], *(c[k] for k in ("confidence", "prominence", "strength", "periodicity", "vowel_likeness", "sonorant_penalty", "weak_recovery"))) for i, c in enumerate(found)], columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return waveforms.filter("samples is not null").select("recording_id", "samples").mapInPandas(run, CANDIDATES)


def frame_tracks(waveforms: DataFrame, settings: signal.Settings = signal.PRODUCTION) -> DataFrame:
    """Frame tracks of whole signals as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, samples in zip(pdf["recording_id"], pdf["samples"], strict=True):
                t = signal.tracks(np.asarray(samples), RATE, settings)
                n = len(t["envelope"])
                yield pd.DataFrame({"recording_id": [rec] * n, "frame": np.arange(n), "t": np.arange(n) * signal.HOP, **{k: t[k] for k in ("envelope", "likelihood", "periodicity", "vowel", "f0")}})

    return waveforms.filter("samples is not null").select("recording_id", "samples").mapInPandas(run, FRAMES)


def word_syllables(words: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Acoustic records of each word's syllables; words too short to analyse are left out.

    Pitch is tracked once a recording and sliced for each syllable.
    """
    padded = windows.drop_short(windows.pad_to_next(words, "recording_id", "word_idx", "start", "end"), "start", "end", "pad_end")
    listed = padded.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start", (F.col("end") + F.col("pad_end")).alias("end")))).alias("words"))
    joined = listed.join(waveforms.select("recording_id", "samples"), "recording_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec, listed_words, samples in pdf.itertuples(index=False):
                x = np.asarray(samples)
                f0, _, _ = pitch.track(x, RATE)
                times = np.arange(len(f0)) * signal.HOP
                for w in listed_words:
                    part = x[int(w["start"] * RATE) : int(w["end"] * RATE)]
                    units = text.split_syllables(w["word"])
                    vowels = sum(c in text.VOWELS for c in w["word"].lower())
                    found, peaks = signal.analyse_word(part, RATE, units, vowels)
                    pitches = [signal.slice_median(times, f0, w["start"] + s["startSec"], w["start"] + s["endSec"]) for s in found]
                    stressed, _ = signal.acoustic_stress(found, pitches)
                    out = []
                    for s, p in zip(found, pitches, strict=True):
                        a = s["acoustics"]
                        core = a.get("core") or {}
                        out.append({"syllable": s["syllable"], "startSec": s["startSec"], "endSec": s["endSec"], "isProblematic": s["isProblematic"], "remarks": s["remarks"], "duration": a.get("duration"), "energyMean": a.get("energyMean"), "central": a.get("central"), "core_duration": core.get("duration"), "core_energy": core.get("energyMean"), "core_central": core.get("central"), "f0": p})
                    rows.append((rec, int(w["word_idx"]), out, peaks, stressed))
            yield pd.DataFrame(rows, columns=["recording_id", "word_idx", "syllables", "detected", "stressed"])

    return joined.select("recording_id", "words", "samples").mapInPandas(run, WORD)


def analyse(words: DataFrame, waveforms: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """Tables of one run: words with flags, syllables, nuclei with their word, pauses, rates, comparison, diagnostics.

    words: recording_id, word_idx, word, start, end, conf. references: recording_id, text (null or empty is free speech).
    """
    key = "recording_id"
    nuclei = candidates(waveforms)
    assigned = intervals.assign_nuclei(words, nuclei, key)
    counts = assigned.filter("word_idx is not null").groupBy(key, "word_idx").agg(F.count("*").alias("nuclei_v2"))
    acoustic = word_syllables(words, waveforms)
    w = words.join(acoustic, [key, "word_idx"]).join(counts, [key, "word_idx"], "left").withColumn("nuclei_v2", F.coalesce("nuclei_v2", F.lit(0)))
    expected = text.vowel_count(F.col("word"))
    w = w.withColumn("text_nuclei", expected).withColumn("count_mismatch", F.col("detected") != expected)
    w = w.withColumn("has_issue", records.word_issue(F.transform("syllables", lambda s: s["isProblematic"]), F.lit(False), F.col("count_mismatch"), F.lit(False)))
    syllables = w.select(key, "word_idx", F.col("stressed"), F.posexplode("syllables").alias("syl_idx", "s")).select(key, "word_idx", "syl_idx", "stressed", "s.*").withColumn("position", stats.position_label(F.col("syl_idx"), F.col("stressed")))
    said = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]).alias("said"))
    compared = said.join(references, key, "left").withColumn("wanted", F.when(F.coalesce("text", F.lit("")) != "", text.spaced_words(F.col("text"))))
    compared = compared.withColumn("diff", align.word_diff(F.coalesce("wanted", F.array().cast("array<string>")), "said"))
    compared = compared.select(key, F.when(F.col("wanted").isNull(), "free").otherwise("prompted").alias("mode"), "diff", F.when(F.col("wanted").isNotNull(), records.word_accuracy(F.col("diff.correct"), F.col("wanted"))).alias("word_accuracy"))
    contrast = stats.contrast_table(syllables.filter("duration is not null").withColumn("on", F.col("position") == "stressed"), "syllable", F.col("on"), "duration", "energyMean")
    return {
        "words": w,
        "syllables": syllables,
        "nuclei": assigned,
        "nuclei_diagnostics": stats.candidate_diagnostics(assigned, key),
        "pauses": windows.pauses(words, key, "word_idx", "start", "end", "word", 2.0),
        "rates": stats.speech_rate(words, key, "word_idx", "start", "end").withColumn("tempo", stats.tempo_class(F.col("rate"))),
        "comparison": compared,
        "contrast": contrast,
        "diagnostics": stats.diagnostics(words, key, "conf"),
    }
