"""Nested analysis records: schema, flattening, word and syllable flags, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.functions.text import REDUCIBLE, SCORED, VOWELS, main_vowel
from prosodia.operators.stats import position_label

CORE = "duration:DOUBLE,energyMean:DOUBLE,formants:ARRAY<DOUBLE>,central:DOUBLE,startInSyl:DOUBLE,endInSyl:DOUBLE"
NUCLEUS = "timeSec:DOUBLE,confidence:DOUBLE,prominence:DOUBLE,strength:DOUBLE,periodicity:DOUBLE,vowelLikeness:DOUBLE,sonorantPenalty:DOUBLE,weakRecovery:BOOLEAN"
#: The record of one analysed recording. Field names are those of the files that tools exchange.
RECORD = f"""
audioFile STRING, durationSec DOUBLE, sampleRate INT, referenceText STRING, recognizedText STRING, analysisMode STRING,
referenceTextProvided BOOLEAN, audioConvertedAutomatically BOOLEAN, recognitionEngine STRING, recognitionDevice STRING,
recognitionDiagnostics STRUCT<recognizedWordCount:INT,meanWordConfidence:DOUBLE,lowConfidenceWordCount:INT,note:STRING>,
wordAnalysis ARRAY<STRUCT<word:STRING,start:DOUBLE,end:DOUBLE,confidence:DOUBLE,lemma:STRING,pos:STRING,syllableStr:STRING,
  syllableCount:INT,textNucleusCount:INT,detectedNuclei:INT,countMismatch:BOOLEAN,detectedNucleiV1:INT,detectedNucleiV2:INT,
  v2Nuclei:ARRAY<STRUCT<{NUCLEUS},timeInWordSec:DOUBLE>>,v2CountMismatch:BOOLEAN,v2MeanConfidence:DOUBLE,v1V2CountAgreement:BOOLEAN,
  stressedIdx:INT,expectedStressedIdx:INT,actualStressedIdx:INT,stressMismatch:BOOLEAN,
  syllableAnalysis:ARRAY<STRUCT<syllable:STRING,startSec:DOUBLE,endSec:DOUBLE,
    acoustics:STRUCT<mfcc:ARRAY<DOUBLE>,energyMean:DOUBLE,zcrMean:DOUBLE,formants:ARRAY<DOUBLE>,central:DOUBLE,duration:DOUBLE,core:STRUCT<{CORE}>>,
    isProblematic:BOOLEAN,remarks:ARRAY<STRING>>>,
  reductionInfo:STRUCT<stressedIdx:INT,stressedSyl:STRING,reductionErrors:ARRAY<STRUCT<syllable:STRING,position:INT,durRatio:DOUBLE,enerRatio:DOUBLE,centralRatio:DOUBLE,hint:STRING>>,reductionScore:DOUBLE,hasReductionIssue:BOOLEAN>,
  hasIssue:BOOLEAN>>,
syllableContrast ARRAY<STRUCT<syllable:STRING,stressDur:DOUBLE,unstrDur:DOUBLE,stressEn:DOUBLE,unstrEn:DOUBLE>>,
pauses ARRAY<STRUCT<afterWord:STRING,beforeWord:STRING,duration:DOUBLE>>,
wordComparison STRUCT<correct:ARRAY<STRING>,substituted:ARRAY<STRUCT<expected:STRING,got:STRING>>,missed:ARRAY<STRING>,inserted:ARRAY<STRING>>,
acousticNucleiV2 STRUCT<algorithm:STRING,configName:STRING,textIndependent:BOOLEAN,count:INT,assignedToRecognizedWords:INT,unassignedCount:INT,meanCandidateConfidence:DOUBLE,config:STRING,nuclei:ARRAY<STRUCT<{NUCLEUS}>>,note:STRING>,
evaluationScores STRUCT<syllableAcoustics:DOUBLE,stressMatch:DOUBLE,vowelReduction:DOUBLE,speechTempo:DOUBLE,wordAccuracy:DOUBLE,compositeScore:DOUBLE,note:STRING>
"""


def words(records: DataFrame, key: str = "recording_id") -> DataFrame:
    """One row a word with its index; old files' missing fields fall back."""
    w = records.select(key, F.posexplode("wordAnalysis").alias("word_idx", "w")).select(key, "word_idx", "w.*")
    stressed = F.coalesce("actualStressedIdx", "stressedIdx", F.lit(-1))
    return w.withColumn("stressed", stressed).withColumn("expected", F.coalesce("expectedStressedIdx", F.lit(-1))).withColumn("syllable_count", F.coalesce("syllableCount", F.size("syllableAnalysis")))


def syllables(word_rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """One row a syllable with absolute times, its core or else its full acoustics, and its position by stress."""
    s = word_rows.select(key, "word_idx", "word", "start", "stressed", "syllable_count", F.posexplode("syllableAnalysis").alias("syl_idx", "s"))
    a = F.col("s.acoustics")
    full = F.struct(*[a[c].alias(c) for c in ("duration", "energyMean", "central")])
    core = F.when(a["core"].isNotNull(), F.struct(*[a["core"][c].alias(c) for c in ("duration", "energyMean", "central")]))
    s = s.withColumn("use", F.coalesce(core, full)).withColumn("is_core", a["core"].isNotNull())
    return s.select(
        key, "word_idx", "word", "syl_idx", "stressed", "syllable_count", F.col("s.syllable").alias("syllable"),
        (F.col("start") + F.col("s.startSec")).alias("start"), (F.col("start") + F.col("s.endSec")).alias("end"),
        F.col("use.duration").alias("duration"), F.col("use.energyMean").alias("energy"), F.col("use.central").alias("central"), "is_core",
        position_label(F.col("syl_idx"), F.col("stressed")).alias("position"),
    )


def all_cores(syllable_array: Column) -> Column:
    """Every syllable of a word has a core (the rule within one word; otherwise none is used)."""
    return F.forall(syllable_array, lambda s: s["acoustics"]["core"].isNotNull())


def measurable(s: DataFrame) -> DataFrame:
    """Syllables that statistics over recordings take: long enough, with a known quality and a vowel."""
    long = F.when(F.col("is_core"), F.col("duration") >= 0.025).otherwise(F.col("duration") >= 0.040)
    valid = (F.col("stressed") >= 0) & (F.col("stressed") < F.col("syllable_count")) & (F.col("syllable_count") > 1)
    return s.withColumn("vowel", main_vowel(F.col("syllable"))).filter(long & (F.col("central") >= 0) & valid & F.col("vowel").isNotNull())


def reducible(syllable: Column) -> Column:
    return F.lower(syllable).rlike(f"[{REDUCIBLE}]")


def scored_vowel(syllable: Column) -> Column:
    return main_vowel(syllable, SCORED)


def any_vowel(syllable: Column) -> Column:
    return main_vowel(syllable, VOWELS)


def quiet(energy: Column, below: float = 0.004) -> Column:
    return energy < below


def word_issue(problematic: Column, reduction: Column, count_mismatch: Column, stress_mismatch: Column) -> Column:
    """A word needs attention if any syllable is problematic or any of three checks failed; a missing check is none."""
    some = lambda c: F.coalesce(c, F.lit(False))
    return F.exists(F.coalesce(problematic, F.array().cast("array<boolean>")), lambda p: some(p)) | some(reduction) | some(count_mismatch) | some(stress_mismatch)


def stress_match(a: Column, b: Column) -> Column:
    """Equal known indices; an unknown one matches nothing."""
    return F.coalesce((a == b) & (a >= 0) & (b >= 0), F.lit(False))


def hide_after(points: DataFrame, t: str, mark: str, cutoff) -> DataFrame:
    """Points after a time become unreviewed."""
    return points.withColumn(mark, F.when(F.col(t) > cutoff, "?").otherwise(F.col(mark)))


def confirmed(points: DataFrame, mark: str = "mark") -> DataFrame:
    """Points with a mark that isn't a question."""
    return points.filter((F.trim(mark) != "") & ~F.col(mark).contains("?"))


def whisper_tokens(tokens: DataFrame, word: str = "word", start: str = "start", end: str = "end", confidence: str = "conf") -> DataFrame:
    """Recognised tokens, cleaned; very short uncertain ones and empty ones go."""
    from prosodia.functions.text import clean_recognised

    short = (F.col(end) - F.col(start) < 0.080) & (F.col(confidence) < 0.85)
    return tokens.filter(~short).withColumn(word, clean_recognised(F.col(word))).filter(F.col(word) != "")


def steady_mean(x: Column) -> Column:
    """Mean of doubles by an exact sum of 14 decimals, so that it doesn't hang on the order of rows; values beyond a decimal's range are averaged as they are."""
    exact = x.try_cast("decimal(28,14)")
    return F.when(F.count(x) == F.count(exact), F.avg(exact).cast("double")).otherwise(F.avg(x))


def scores(word_rows: DataFrame, syllable_rows: DataFrame, rates: DataFrame, key: str = "recording_id") -> DataFrame:
    """Four component scores of each recording, each null without data; there is no composite.

    acoustics: 20 % loud enough, 40 % with a core, 40 % with the expected count. stress: share of known pairs that match. reduction: mean ratio
    (at most 1.5) of unstressed to stressed duration over vowels with three of both, from 0.70 (100) to 1.00 (20 at least). tempo: distance from 3 words a second.
    No score depends on the order of rows, nor does its rounding.
    """
    s = syllable_rows.groupBy(key).agg(F.avg((~quiet(F.col("energy"))).cast("int")).alias("loud"), F.avg(F.col("is_core").cast("int")).alias("core"))
    w = word_rows.groupBy(key).agg(
        F.avg((~F.coalesce("countMismatch", F.lit(False))).cast("int")).alias("count"),
        F.avg(F.when((F.col("stressed") >= 0) & (F.col("expected") >= 0) & (F.col("syllable_count") > 1), (F.col("stressed") == F.col("expected")).cast("int"))).alias("stress"),
    )
    v = syllable_rows.filter((F.col("duration") >= 0.025) & (F.col("stressed") >= 0) & (F.col("syllable_count") > 1)).withColumn("vowel", scored_vowel(F.col("syllable"))).filter("vowel is not null")
    on = F.col("position") == "stressed"
    v = v.groupBy(key, "vowel").agg(*[f(F.when(c, F.col("duration"))).alias(n) for n, f, c in (("a", steady_mean, on), ("b", steady_mean, ~on), ("na", F.count, on), ("nb", F.count, ~on))]).filter("na >= 3 and nb >= 3 and a > 0")
    # a recording has few vowels: their ratios are added in order of size
    v = v.groupBy(key).agg(F.array_sort(F.collect_list(F.least(F.col("b") / F.col("a"), F.lit(1.5)))).alias("x"))
    v = v.select(key, (F.aggregate("x", F.lit(0.0), lambda t, r: t + r) / F.size("x")).alias("ratio"))
    redux = F.greatest(F.lit(20.0), F.least(F.lit(100.0), 100 - (F.col("ratio") - 0.70) / 0.30 * 60))
    tempo = F.greatest(F.lit(0.0), 100 * (1 - 0.5 * F.abs(F.col("rate") - 3) / 3))
    out = w.join(s, key, "left").join(v, key, "left").join(rates.select(key, "rate"), key, "left")
    return out.select(
        key,
        F.round(100 * (0.2 * F.col("loud") + 0.4 * F.col("core") + 0.4 * F.col("count")), 1).alias("syllable_acoustics"),
        F.round(100 * F.col("stress"), 1).alias("stress_match"),
        F.round(F.when(F.col("ratio").isNotNull(), redux), 1).alias("vowel_reduction"),
        F.round(F.when(F.col("rate") > 0, tempo), 1).alias("speech_tempo"),
    )


def word_accuracy(correct: Column, reference: Column) -> Column:
    """Share of reference words that are correct; null, not 0, without a reference."""
    return F.size(correct) / F.nullif(F.size(reference), F.lit(0))


def shown_accuracy(correct: Column, missed: Column, substituted: Column) -> Column:
    """The same for display, over correct, missed and substituted words."""
    return F.size(correct) / F.nullif(F.size(correct) + F.size(missed) + F.size(substituted), F.lit(0))


def summary(word_rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Per recording: words, words without an issue, matching stresses of known ones, and words with reduction errors."""
    known = (F.col("stressed") >= 0) & (F.col("expected") >= 0) & (F.col("syllable_count") > 1)
    return word_rows.groupBy(key).agg(
        F.count("*").alias("words"), F.count_if(~F.coalesce("hasIssue", F.lit(False))).alias("good_words"),
        F.count_if(known & (F.col("stressed") == F.col("expected"))).alias("stress_matches"), F.count_if(known).alias("stress_known"),
        F.count_if(F.coalesce("reductionInfo.hasReductionIssue", F.lit(False))).alias("reduction_issues"),
    )


def word_plot(word_rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Layers to draw a word: the word, its syllables, their cores and its nuclei, on the recording's time axis."""
    layer = lambda name, start, end, label: F.struct(F.lit(name).alias("layer"), start.alias("start"), end.alias("end"), label.alias("label"))
    some = lambda c, f: F.coalesce(F.transform(c, f), F.array())
    base = lambda s: F.col("start") + s["startSec"]
    core = lambda s: s["acoustics"]["core"]
    # all layers from one pass over the words
    layers = F.concat(
        F.array(layer("word", F.col("start"), F.col("end"), F.col("word"))),
        some(F.col("syllableAnalysis"), lambda s: layer("syllable", base(s), F.col("start") + s["endSec"], s["syllable"])),
        some(F.filter("syllableAnalysis", lambda s: core(s).isNotNull()), lambda s: layer("core", base(s) + core(s)["startInSyl"], base(s) + core(s)["endInSyl"], s["syllable"])),
        some(F.col("v2Nuclei"), lambda n: layer("nucleus", n["timeSec"], n["timeSec"], F.format_string("%.2f", n["confidence"]))),
    )
    return word_rows.select(key, "word_idx", F.explode(layers).alias("x")).select(key, "word_idx", "x.*")


def formant_points(word_rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """First and second formants of plausible syllables with whether they are stressed."""
    from prosodia.functions.arrays import plausible_formants

    s = word_rows.select(key, "word_idx", "stressed", F.posexplode("syllableAnalysis").alias("syl_idx", "s"))
    f = F.coalesce(F.col("s.acoustics.core.formants"), F.col("s.acoustics.formants"))
    return s.withColumn("f", f).filter(plausible_formants(F.col("f"))).select(key, "word_idx", "syl_idx", F.col("s.syllable").alias("label"), F.get("f", F.lit(0)).alias("f1"), F.get("f", F.lit(1)).alias("f2"), (F.col("syl_idx") == F.col("stressed")).alias("is_stressed"))
