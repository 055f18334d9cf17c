"""Other inputs: waveforms, analysis records, transcripts, ground truth, pairing of files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.functions.deferred import arrow_function
from prosodia.operators.records import RECORD

#: Audio file endings by preference.
AUDIO = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "wma")
RATE = 16_000


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def ready_wave(content: bytes) -> bool:
    """Uncompressed, mono, 16 kHz, 16 bit; anything that isn't a wave file is not."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getcomptype()) == (1, RATE, 2, "NONE")
    except (wave.Error, EOFError):
        return False


@arrow_function("boolean")
def is_ready(content: pd.Series) -> pd.Series:
    return content.map(lambda c: bool(c is not None and ready_wave(c)))


def decode_wave(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples from -1 to 1 at ``rate``: channels averaged, other rates interpolated."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 2:
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768
    elif width == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif width == 4:
        x = np.frombuffer(raw, dtype="<i4").astype(np.float32) / 2147483648
    else:
        raise ValueError(f"{8 * width} bit samples")
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        n = int(round(len(x) * rate / own))
        x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x


def encode_wave(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    """Sixteen digits that name a file's state."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string")), 256), 1, 16)


def waveforms(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, fingerprint, ready, samples, error: a row a file; what cannot be decoded says why."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(stem(F.col("path")).alias("recording_id"), fingerprint(F.col("path"), F.col("length"), F.col("modificationTime")).alias("fingerprint"), "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for rec, mark, content in pdf.itertuples(index=False):
                try:
                    rows.append((rec, mark, ready_wave(content), decode_wave(content), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((rec, mark, False, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["recording_id", "fingerprint", "ready", "samples", "error"])

    return files.mapInPandas(run, "recording_id string, fingerprint string, ready boolean, samples array<float>, error string")


def preferred_audio(files: DataFrame) -> DataFrame:
    """Of (path) the one of each stem whose ending comes first."""
    from prosodia.operators.ranking import top_per

    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    order = F.array_position(F.array(*[F.lit(a) for a in AUDIO]), ending)
    own = files.withColumn("recording_id", stem(F.col("path"))).withColumn("__o", order).filter("__o > 0")
    return top_per(own, ["recording_id"], 1, F.col("__o"), F.col("path")).drop("__o")


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """Analysis records with their recording; the schema is fixed, fields that a file lacks are null."""
    records = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return records.withColumn("recording_id", F.regexp_replace(stem(F.input_file_name()), "_syllable_analysis$", ""))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, word_idx, word, n from a map of lists; keys that begin with _ are comments."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("recording_id", "list"))
    rows = rows.filter(~F.col("recording_id").startswith("_"))
    return rows.select("recording_id", F.posexplode(F.from_json("list", "array<array<string>>")).alias("word_idx", "w")).select("recording_id", "word_idx", F.get("w", F.lit(0)).alias("word"), F.get("w", F.lit(1)).cast("int").alias("n"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """recording_id and trimmed text of each text file; empty text is free speech."""
    own = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("recording_id"), F.trim(F.regexp_replace("value", r"^﻿|^\s+|\s+$", "")).alias("text"))
    return own.withColumn("mode", F.when(F.col("text") == "", "free").otherwise("prompted"))


def pair(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Every recording with its text, null if there is none."""
    return audio.join(texts, "recording_id", "left")


def common(*tables: DataFrame) -> DataFrame:
    """Recordings that all tables have."""
    own = [t.select("recording_id") for t in tables]
    out = own[0].distinct()
    for t in own[1:]:
        out = out.intersect(t)
    return out


def missing(wanted: DataFrame, *tables: DataFrame) -> DataFrame:
    """recording_id and the position of each table that lacks it."""
    out = None
    for i, t in enumerate(tables):
        own = wanted.select("recording_id").distinct().join(t.select("recording_id").distinct(), "recording_id", "left_anti").withColumn("missing", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out
