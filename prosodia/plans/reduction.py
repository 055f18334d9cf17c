"""Vowel reduction over recordings: every vowel and position against the stressed one, with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.operators import records, stats


def measures(analyses: DataFrame) -> DataFrame:
    """recording_id, vowel, position, duration, energy, central: one row a measurable syllable."""
    return records.measurable(records.syllables(records.words(analyses))).select("recording_id", "vowel", "position", "duration", "energy", "central")


def compare(rows: DataFrame, pooled: Column | None = None, pool_name: str = "nonnative_pooled", collapse: bool = False) -> DataFrame:
    """Per recording, vowel and position: duration, energy and quality against the stressed position, and the verdict.

    ``pooled`` marks recordings that also count together; whether a speaker is native must come from the data, not
    from a name. ``collapse`` makes all unstressed positions one.
    """
    if pooled is not None:
        rows = stats.group_pool(rows, "recording_id", pooled, pool_name)
    if collapse:
        rows = rows.withColumn("position", F.when(F.col("position") == "stressed", "stressed").otherwise("unstressed"))
    by = ["recording_id", "vowel"]
    out = None
    for value in ("duration", "energy", "central"):
        one = stats.compare(rows, by, "position", "stressed", value)
        keep = [F.round(c, 4).alias(f"{value}_{c}") for c in ("mean", "rmean")] + [F.round(c, 2).alias(f"{value}_{c}") for c in ("ratio", "ci_low", "ci_high", "d")] + [F.col(c).alias(f"{value}_{c}") for c in ("p", "sig")]
        one = one.select(*by, "position", *(["n", "rn"] if out is None else []), F.col("ratio").alias(f"__{value}"), *keep)
        out = one if out is None else out.join(one, [*by, "position"])
    can = (F.col("n") >= stats.TEST_N) & (F.col("rn") >= stats.TEST_N)
    out = out.withColumn("verdict", stats.verdict(F.col("__duration"), F.col("duration_p"), F.col("__central"), F.col("central_p"), can))
    return out.drop("__duration", "__energy", "__central")


def forest(compared: DataFrame, value: str = "duration") -> DataFrame:
    """Rows to draw ratios with intervals: tested groups only, by ratio."""
    return compared.filter((F.col("n") >= stats.TEST_N) & (F.col("rn") >= stats.TEST_N)).select("recording_id", "vowel", "position", *[f"{value}_{c}" for c in ("ratio", "ci_low", "ci_high", "sig")]).orderBy(f"{value}_ratio")


def boxes(rows: DataFrame, value: str = "duration") -> DataFrame:
    """Five-number summaries by vowel and position, of groups of ten or more."""
    return rows.groupBy("vowel", "position").agg(F.count("*").alias("n"), *stats.five_numbers(value)).filter(F.col("n") >= stats.TEST_N)
