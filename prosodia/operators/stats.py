"""Aggregations and statistics: contrasts, tests, accuracy, error rates, scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions.arrays import safe_ratio, student_p
from prosodia.operators import ordered

#: Least rows of a group to report it, and of both groups to test them.
REPORT_N, TEST_N = 3, 10


def contrast_table(df: DataFrame, by: str, stressed: Column, duration: str, energy: str) -> DataFrame:
    """Mean duration and energy of stressed and unstressed rows; groups that lack either are left out."""
    on, off = stressed, ~stressed
    out = df.groupBy(by).agg(
        *[F.avg(F.when(c, F.col(x))).alias(n) for n, c, x in (("stress_dur", on, duration), ("unstr_dur", off, duration), ("stress_en", on, energy), ("unstr_en", off, energy))],
        F.count(F.when(on, 1)).alias("__on"), F.count(F.when(off, 1)).alias("__off"),
    )
    out = out.filter("__on > 0 and __off > 0")
    return out.select(by, *[F.round(c, 3 if "dur" in c else 5).alias(c) for c in ("stress_dur", "unstr_dur", "stress_en", "unstr_en")])


def unit_frequency(df: DataFrame, units: Column, order: list[str]) -> DataFrame:
    """How often each unit of an array occurs, with the rank by count; ties go by first occurrence.

    ``order`` are the columns that order rows; the position in the array comes after them. Ranks come from range
    partitions and prefix sums, so no task sorts all units.
    """
    each = df.select(*order, F.posexplode(units).alias("__pos", "unit"))
    out = each.groupBy("unit").agg(F.count("*").alias("count"), F.min(F.struct(*order, "__pos")).alias("__first"))
    return ordered.ranked(out, [F.desc("count"), F.col("__first")]).drop("__first")


def unit_totals(frequency: DataFrame) -> DataFrame:
    return frequency.agg(F.count("*").alias("unique_units"), F.coalesce(F.sum("count"), F.lit(0)).alias("occurrences"))


def speech_rate(words: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """Duration from the first word's start to the last word's end, words, and words a second (0 without duration)."""
    g = words.groupBy(key).agg(F.min_by(start, order).alias("__s"), F.max_by(end, order).alias("__e"), F.count("*").alias("n_words"))
    d = F.col("__e") - F.col("__s")
    return g.select(key, d.alias("duration"), "n_words", F.when(d > 0, F.col("n_words") / d).otherwise(0.0).alias("rate"))


def tempo_class(rate: Column, low: float = 2.0, high: float = 3.5) -> Column:
    return F.when(rate < low, "slow").when(rate > high, "fast").otherwise("normal")


def position_label(index: Column, stressed: Column) -> Column:
    return F.when(index == stressed, "stressed").when(index == stressed - 1, "pretonic").when(index == stressed + 1, "posttonic").otherwise("other_unstressed")


def group_pool(df: DataFrame, group: str, member: Column, name: str) -> DataFrame:
    """All rows, and those of members once more under a pooled name."""
    return df.unionByName(df.filter(member).withColumn(group, F.lit(name)))


def moments(df: DataFrame, by: list[str], side: str, values: list[str]) -> DataFrame:
    """n, mean and sample deviation of values per group and side, one pass with map-side combine."""
    return df.groupBy(*by, side).agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))])


def two_groups(m: DataFrame, by: list[str], side: str, value: str, reference: str) -> DataFrame:
    """Every side against the reference side of its group: n, mean, sd of both (r for the reference)."""
    pick = [F.col(f"{k}_{value}").alias(k) for k in ("n", "mean", "sd")]
    own = m.filter(F.col(side) != reference).select(*by, side, *pick)
    ref = m.filter(F.col(side) == reference).select(*by, *[p.alias(f"r{k}") for p, k in zip(pick, ("n", "mean", "sd"), strict=True)])
    return own.join(ref, by)


def _var(sd: str) -> Column:
    return F.coalesce(F.col(sd) * F.col(sd), F.lit(0.0))


def ratio_with_ci(df: DataFrame) -> DataFrame:
    """ratio of means with a 95 % interval by the delta method; null where the reference mean is 0."""
    r = safe_ratio(F.col("mean"), F.col("rmean"))
    a = safe_ratio(F.sqrt(_var("sd") / F.col("n")), F.col("rmean"))
    b = safe_ratio(F.col("mean") * F.sqrt(_var("rsd") / F.col("rn")), F.col("rmean") * F.col("rmean"))
    se = F.sqrt(a * a + b * b)
    return df.withColumn("ratio", r).withColumn("ci_low", r - 1.96 * se).withColumn("ci_high", r + 1.96 * se)


def cohens_d(df: DataFrame) -> DataFrame:
    """Difference of means in pooled deviations: null below two rows a side, 0 or infinite if nothing varies."""
    pooled = F.sqrt(((F.col("n") - 1) * _var("sd") + (F.col("rn") - 1) * _var("rsd")) / F.nullif(F.col("n") + F.col("rn") - 2, F.lit(0)))
    diff = F.col("mean") - F.col("rmean")
    flat = F.when(diff == 0, 0.0).when(diff > 0, float("inf")).otherwise(float("-inf"))
    return df.withColumn("d", F.when((F.col("n") >= 2) & (F.col("rn") >= 2), F.when(pooled == 0, flat).otherwise(diff / F.nullif(pooled, F.lit(0.0)))))


def welch(df: DataFrame) -> DataFrame:
    """Welch's t and its degrees of freedom; null below two rows a side or if neither side varies.

    If one side does not vary the degrees are the larger n less one.
    """
    a, b = _var("sd") / F.col("n"), _var("rsd") / F.col("rn")
    ok = (F.col("n") >= 2) & (F.col("rn") >= 2) & (a + b > 0)
    df_ = F.when((a == 0) | (b == 0), (F.greatest("n", "rn") - 1).cast("double")).otherwise((a + b) * (a + b) / F.nullif(a * a / (F.col("n") - 1) + b * b / (F.col("rn") - 1), F.lit(0.0)))
    return df.withColumn("t", F.when(ok, (F.col("mean") - F.col("rmean")) / F.sqrt(F.nullif(a + b, F.lit(0.0))))).withColumn("df", F.when(ok, df_))


def significance(p: Column, enough: Column) -> Column:
    return F.when(~enough | p.isNull(), f"N<{TEST_N}").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def compare(df: DataFrame, by: list[str], side: str, reference: str, value: str) -> DataFrame:
    """One feature of every side against the reference: n, means, ratio with interval, d, t, df, p and a marker.

    Groups below three rows on either side are not reported; p needs ten on both.
    """
    out = two_groups(moments(df, by, side, [value]), by, side, value, reference).filter((F.col("n") >= REPORT_N) & (F.col("rn") >= REPORT_N))
    out = welch(cohens_d(ratio_with_ci(out)))
    enough = (F.col("n") >= TEST_N) & (F.col("rn") >= TEST_N)
    return out.withColumn("p", F.when(enough, student_p("t", "df"))).withColumn("sig", significance(F.col("p"), enough))


def verdict(dur_ratio: Column, dur_p: Column, central_ratio: Column, central_p: Column, can_test: Column) -> Column:
    """How clearly a position is reduced, from two features."""
    sure = lambda p: F.coalesce(p < 0.05, F.lit(False))
    below = lambda r, x: F.coalesce(r < x, F.lit(False))
    strong = sure(dur_p) & below(dur_ratio, 0.80) & sure(central_p) & below(central_ratio, 0.85)
    some = (sure(dur_p) & below(dur_ratio, 0.90)) | (sure(central_p) & below(central_ratio, 0.92))
    return F.when(~can_test, "descriptive").when(strong, "strong").when(some, "moderate").otherwise("not proven")


def reduction_per_group(df: DataFrame, key: list[str], index: str, stressed: str, duration: str, energy: str, central: str, reducible: Column, limits: tuple[float, float, float] = (0.85, 0.80, 0.90)) -> DataFrame:
    """Per word: unstressed reducible units checked against the stressed one, errors, and the share without an error.

    A ratio above its limit is an error; quality counts only where both are known (not negative). A stressed value of 0 counts as 1e-6.
    Words without a unit to check score 100.
    """
    values = (duration, energy, central)
    # the stressed units of a word stand beside each of its units; a word without a whole key has none
    ref = F.collect_list(F.when(F.col(index) == F.col(stressed), F.struct(*[F.col(v).alias(f"r{i}") for i, v in enumerate(values)]))).over(Window.partitionBy(*key))
    named = reduce(and_, [F.col(k).isNotNull() for k in key])
    own = (F.col(index) != F.col(stressed)) & reducible & named

    def bad(r: Column) -> Column:
        ratio = [F.col(v) / F.when(r[f"r{i}"] == 0, 1e-6).otherwise(r[f"r{i}"]) for i, v in enumerate(values)]
        known = (F.col(central) >= 0) & (r["r2"] >= 0)
        return (ratio[0] >= limits[0]) | (ratio[1] >= limits[1]) | (known & (ratio[2] >= limits[2]))

    rows = df.withColumn("__own", own).withColumn("__ref", ref)
    one = rows.select(*key, F.when(F.col("__own"), F.size("__ref")).otherwise(0).alias("n"), F.when(F.col("__own"), F.size(F.filter("__ref", bad))).otherwise(0).alias("bad"))
    out = one.groupBy(*key).agg(F.sum("n").alias("checked"), F.sum("bad").alias("errors"))
    checked, errors = F.coalesce("checked", F.lit(0)), F.coalesce("errors", F.lit(0))
    score = F.when(checked == 0, 100.0).otherwise((checked - errors) * 100.0 / F.nullif(checked, F.lit(0)))
    return out.select(*key, checked.alias("checked"), errors.alias("errors"), score.alias("reduction_score"), (errors > 0).alias("has_issue"))


def p90(values: str) -> Column:
    """The element at floor(0.9 n) of the sorted values, 0 for none: no interpolation."""
    s = F.array_sort(F.collect_list(values))
    return F.coalesce(F.try_element_at(s, (F.floor(F.size(s) * 0.9) + 1).cast("int")), F.lit(0.0))


def boundary_errors(pairs: DataFrame, key: list[str], found: str, truth: str) -> DataFrame:
    """Absolute errors of unit starts and of the last end, in ms, where both sides have as many units.

    ``found`` and ``truth`` are arrays of (start, end).
    """
    same = pairs.filter(F.size(found) == F.size(truth))
    starts = F.zip_with(F.col(found), F.col(truth), lambda a, b: F.abs(a["start"] - b["start"]) * 1000)
    last = F.abs(F.element_at(found, -1)["end"] - F.element_at(truth, -1)["end"]) * 1000
    return same.filter(F.size(found) > 0).select(*key, F.explode(F.concat(starts, F.array(last))).alias("error_ms"))


def accuracy(df: DataFrame, key: str, hit: Column, name: str = "accuracy") -> DataFrame:
    """Hits, totals and percentage per key, and over all rows (key null): the total pools hits, not percentages."""
    out = df.rollup(key).agg(F.count(F.when(hit, 1)).alias("hits"), F.count("*").alias("total"))
    return out.withColumn(name, F.coalesce(F.col("hits") * 100.0 / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def stress_agreement(words: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Agreement of two stress indices where both are known (>= 0), per key and syllable count, and per key and over all."""
    known = words.filter((F.col(a) >= 0) & (F.col(b) >= 0) & (F.col("syllable_count") > 1))
    out = known.rollup(key, "syllable_count").agg(F.count(F.when(F.col(a) == F.col(b), 1)).alias("matching"), F.count("*").alias("total"))
    return out.withColumn("percent", F.round(F.col("matching") * 100.0 / F.col("total"), 1))


def wer(rows: DataFrame, *by: str) -> DataFrame:
    """Word error rate in percent, two decimals, from columns words, s, d, i summed per ``by``; it may exceed 100."""
    out = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("words", "s", "d", "i")])
    return out.withColumn("wer", F.round(safe_ratio((F.col("s") + F.col("d") + F.col("i")) * 100.0, F.col("words")), 2))


def summary(x: str) -> list[Column]:
    """Mean, greatest, least and population deviation of a column, 0 for none."""
    return [F.coalesce(f(x), F.lit(0.0)).alias(n) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))]


def five_numbers(x: str) -> list[Column]:
    return [F.min(x).alias("low"), *[F.percentile(x, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(x).alias("high")]


def balanced_count_accuracy(words: DataFrame, key: str, hit: Column) -> DataFrame:
    """Mean of the recordings' percentages, and the pooled percentage."""
    per = words.groupBy(key).agg(F.count(F.when(hit, 1)).alias("h"), F.count("*").alias("n"))
    return per.agg(F.avg(F.col("h") * 100.0 / F.col("n")).alias("balanced"), (F.sum("h") * 100.0 / F.sum("n")).alias("pooled"))


def diagnostics(words: DataFrame, key: str, confidence: str, low: float = 0.70) -> DataFrame:
    """Words, mean confidence (three decimals, null without words) and how many are below ``low``."""
    return words.groupBy(key).agg(F.count("*").alias("recognized_word_count"), F.round(F.avg(confidence), 3).alias("mean_word_confidence"), F.count_if(F.col(confidence) < low).alias("low_confidence_word_count"))


def candidate_diagnostics(assigned: DataFrame, key: str) -> DataFrame:
    """Candidates, those assigned to a word or not, and their mean confidence."""
    has = F.col("word_idx").isNotNull()
    return assigned.groupBy(key).agg(F.count("*").alias("count"), F.count_if(has).alias("assigned"), F.count_if(~has).alias("unassigned"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def pivot_means(df: DataFrame, by: str, column: str, values: list[str], x: str, keep: Column | None = None) -> DataFrame:
    """Mean of x by row and column of a table, 0 for empty cells; ``keep`` selects rows by their counts n_<value>."""
    out = df.groupBy(by).agg(*[F.coalesce(F.avg(F.when(F.col(column) == v, F.col(x))), F.lit(0.0)).alias(v) for v in values], *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])
    return (out.filter(keep) if keep is not None else out).select(by, *values)
