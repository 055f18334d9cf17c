"""The library's operators as queries over the driver's tables, each with DuckDB SQL where SQL can say it.

``events`` play recordings (user), times and scores; ``lineitem`` plays syllables (order = word);
``documents`` and ``conversations`` give texts. Times are seconds since 1970 as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosodia.functions import arrays, text
from prosodia.operators import align, events, intervals, ranking, stats, windows

HOUR = 3600.0
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def timed(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    e = table(spark, d, "events")
    e = e.filter(F.col("event_type").isin(*kinds)) if kinds else e
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6
    return e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("id"), t.alias("t"), "value", "event_type")


def spans(spark: SparkSession, d: str, length: float = 2 * HOUR) -> DataFrame:
    """Clicks as intervals: idx, start, end, quota."""
    c = timed(spark, d, "click")
    return c.select("rec", F.col("id").alias("idx"), F.col("t").alias("start"), (F.col("t") + length).alias("end"), (F.col("id") % 3).alias("quota"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


EV = "SELECT user_id AS rec, event_id AS id, epoch_us(ts) / 1e6::DOUBLE AS t, value, event_type FROM events"
CL = f"SELECT rec, id AS idx, t AS start, t + 7200.0::DOUBLE AS \"end\", id % 3 AS quota FROM ({EV}) WHERE event_type = 'click'"
PU = f"SELECT * FROM ({EV}) WHERE event_type = 'purchase'"
WITH = f"WITH ev AS ({EV}), cl AS ({CL}), pu AS ({PU})"

# --- statistics ------------------------------------------------------------------------------


@query("""
SELECT CAST(grp AS BIGINT) AS grp, round(a, 3) AS stress_dur, round(b, 3) AS unstr_dur, round(c, 5) AS stress_en, round(e, 5) AS unstr_en FROM (
  SELECT l_partkey % 50 AS grp, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag <> 'R') AS b,
         avg(l_discount) FILTER (l_returnflag = 'R') AS c, avg(l_discount) FILTER (l_returnflag <> 'R') AS e
  FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL
""")
def contrast_table(spark, d):
    li = table(spark, d, "lineitem").withColumn("grp", F.col("l_partkey") % 50)
    return stats.contrast_table(li, "grp", F.col("l_returnflag") == "R", "l_quantity", "l_discount")


CONTRAST = """
WITH m AS (
  SELECT l_linestatus AS vowel, l_returnflag AS position, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd
  FROM (SELECT *, VALUE AS x FROM lineitem) GROUP BY 1, 2
), j AS (
  SELECT o.vowel, o.position, o.n, o.mean, o.sd * o.sd AS v, r.n AS rn, r.mean AS rmean, r.sd * r.sd AS rv
  FROM m o JOIN m r ON o.vowel = r.vowel AND r.position = 'R' AND o.position <> 'R' WHERE o.n >= 3 AND r.n >= 3
), k AS (
  SELECT *, mean / rmean AS ratio, sqrt(pow(sqrt(v / n) / rmean, 2) + pow(mean * sqrt(rv / rn) / (rmean * rmean), 2)) AS se,
         sqrt(((n - 1) * v + (rn - 1) * rv) / (n + rn - 2)) AS pooled, v / n + rv / rn AS s FROM j
)
SELECT vowel, position, n, rn, round(mean, 6) AS mean, round(rmean, 6) AS rmean, round(ratio, 6) AS ratio, round(ratio - 1.96 * se, 6) AS ci_low, round(ratio + 1.96 * se, 6) AS ci_high,
       round((mean - rmean) / pooled, 6) AS d, round((mean - rmean) / sqrt(s), 6) AS t, round(s * s / (pow(v / n, 2) / (n - 1) + pow(rv / rn, 2) / (rn - 1)), 4) AS df
FROM k
"""


def _contrast(spark, d, value):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("vowel"), F.col("l_returnflag").alias("position"), F.col(value).cast("double").alias("x"))
    return stats.compare(li, ["vowel"], "position", "R", "x")


@query(CONTRAST.replace("VALUE", "l_quantity"))
def contrast_stats(spark, d):
    out = rounded(_contrast(spark, d, "l_quantity"), "mean", "rmean", "ratio", "ci_low", "ci_high", "d", "t").withColumn("df", F.round("df", 4))
    return out.select("vowel", "position", "n", "rn", "mean", "rmean", "ratio", "ci_low", "ci_high", "d", "t", "df")


@query()
def contrast_verdict(spark, d):
    """p values, markers and the verdict from duration and quality."""
    key = ["vowel", "position"]
    q, c = (_contrast(spark, d, v).select(*key, "n", "rn", *[F.col(x).alias(f"{n}_{x}") for x in ("ratio", "p", "sig")]) for v, n in (("l_quantity", "dur"), ("l_discount", "central")))
    j = q.join(c.drop("n", "rn"), key)
    can = (F.col("n") >= 10) & (F.col("rn") >= 10)
    return j.withColumn("verdict", stats.verdict(F.col("dur_ratio"), F.col("dur_p"), F.col("central_ratio"), F.col("central_p"), can))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS st FROM lineitem),
u AS (SELECT DISTINCT * FROM b),
r AS (SELECT l_orderkey, max(l_quantity) AS q, max(l_extendedprice) AS e, max(l_discount) AS c FROM u WHERE l_linenumber = st GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT u.l_orderkey, count(*) AS checked, count(*) FILTER (u.l_quantity / (CASE WHEN r.q = 0 THEN 1e-6 ELSE r.q END) >= 0.85::DOUBLE
   OR u.l_extendedprice / (CASE WHEN r.e = 0 THEN 1e-6 ELSE r.e END) >= 0.80::DOUBLE OR u.l_discount / (CASE WHEN r.c = 0 THEN 1e-6 ELSE r.c END) >= 0.90::DOUBLE) AS errors
  FROM u JOIN r USING (l_orderkey) WHERE u.l_linenumber <> u.st GROUP BY 1)
SELECT o.l_orderkey, coalesce(checked, 0) AS checked, coalesce(errors, 0) AS errors,
       round(CASE WHEN coalesce(checked, 0) = 0 THEN 100.0::DOUBLE ELSE (checked - errors) * 100.0::DOUBLE / checked END, 6) AS reduction_score, coalesce(errors, 0) > 0 AS has_issue
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN x USING (l_orderkey)
""")
def reduction_per_group(spark, d):
    """Lines of an order as syllables; the first is stressed (orders whose first line repeats have no single one)."""
    values = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    order, line = Window.partitionBy("l_orderkey"), F.struct(*values)
    # equal lines lie side by side in the one sort that the later steps share
    li = table(spark, d, "lineitem").select("l_orderkey", *values).withColumn("again", F.lag(line).over(order.orderBy(*values)).eqNullSafe(line)).filter(~F.col("again")).drop("again")
    li = li.withColumn("st", F.min("l_linenumber").over(order))
    firsts = F.count(F.when(F.col("l_linenumber") == F.col("st"), 1)).over(order)
    li = li.withColumn("st", F.when(firsts == 1, F.col("st")).otherwise(F.lit(None)))
    out = stats.reduction_per_group(li.withColumn("__i", F.col("l_linenumber")), ["l_orderkey"], "__i", "st", "l_quantity", "l_extendedprice", "l_discount", F.lit(True))
    return rounded(out, "reduction_score")


@query(r"""
SELECT unit, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min((doc_id, pos))) AS rank FROM (
  SELECT doc_id, unnest(w) AS unit, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents)
) GROUP BY unit
""")
def syllable_frequency(spark, d):
    docs = table(spark, d, "documents")
    return stats.unit_frequency(docs, F.filter(F.split(F.lower("text"), " "), lambda w: w != ""), ["doc_id"]).select("unit", F.col("count"), F.col("rank").cast("long").alias("rank"))


@query(r"""
SELECT count(DISTINCT u) AS unique_units, count(*) AS occurrences FROM (SELECT unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS u FROM documents)
""")
def syllable_totals(spark, d):
    docs = table(spark, d, "documents")
    each = docs.select(F.explode(F.filter(F.split(F.lower("text"), " "), lambda w: w != "")).alias("unit")).groupBy("unit").agg(F.count("*").alias("count"))
    return stats.unit_totals(each)


@query(f"""{WITH}, g AS (SELECT rec, arg_min(t, t) AS s, arg_max(t, t) AS e, count(*) AS n FROM ev GROUP BY rec)
SELECT rec, round(e - s, 6) AS duration, n AS n_words, round(CASE WHEN e > s THEN n / ((e - s) / 86400.0::DOUBLE) ELSE 0 END, 6) AS rate,
  CASE WHEN n / ((e - s) / 86400.0::DOUBLE) < 2.0 THEN 'slow' WHEN n / ((e - s) / 86400.0::DOUBLE) > 3.5 THEN 'fast' ELSE 'normal' END AS tempo FROM g""")
def speech_rate(spark, d):
    e = timed(spark, d)
    out = stats.speech_rate(e, "rec", "t", "t", "t")
    daily = F.when(F.col("duration") > 0, F.col("n_words") / (F.col("duration") / 86400.0)).otherwise(0.0)
    return rounded(out.withColumn("rate", daily).withColumn("tempo", stats.tempo_class(daily)), "duration", "rate")


@query("""
SELECT l_partkey, CAST(l[CAST(floor(len(l) * 0.9::DOUBLE) AS BIGINT) + 1] AS DOUBLE) AS p90, m AS median, round(a, 6) AS mean
FROM (SELECT l_partkey, list(l_quantity ORDER BY l_quantity) AS l, median(l_quantity) AS m, avg(l_quantity) AS a FROM lineitem GROUP BY 1)
""")
def p90_index(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_partkey").agg(stats.p90("l_quantity").alias("p90"), F.median("l_quantity").alias("median"), F.round(F.avg("l_quantity"), 6).alias("mean"))


ROBUST = """
WITH s AS (SELECT l_partkey, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) AS b, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(greatest(-LIMIT, least(LIMIT, (l_quantity - m) / (SCALE))), 6) AS z FROM lineitem JOIN s USING (l_partkey)
"""


@query(ROBUST.replace("LIMIT", "5.0::DOUBLE").replace("SCALE", "CASE WHEN (b - a) / 1.349::DOUBLE < 1e-6 THEN greatest(sd, 1e-6::DOUBLE) ELSE (b - a) / 1.349::DOUBLE END"))
def robust_z(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return rounded(arrays.robust_z(li, "l_partkey", "l_quantity").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "z"), "z")


@query(ROBUST.replace("LIMIT", "6.0::DOUBLE").replace("SCALE", "greatest((b - a) / 1.349::DOUBLE, sd, 1e-6::DOUBLE)"))
def robust_z_greatest(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return rounded(arrays.robust_z(li, "l_partkey", "l_quantity", style="greatest", limit=6.0).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "z"), "z")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS total, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def micro_macro_accuracy(spark, d):
    return rounded(stats.accuracy(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"), "accuracy")


@query("""
SELECT round(avg(h * 100.0::DOUBLE / n), 6) AS balanced, round(sum(h) * 100.0::DOUBLE / sum(n), 6) AS pooled FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS h, count(*) AS n FROM orders GROUP BY 1)
""")
def balanced_accuracy(spark, d):
    return rounded(stats.balanced_count_accuracy(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F"), "balanced", "pooled")


@query("""
SELECT o_orderpriority, n, count(*) FILTER (a = b) AS matching, count(*) AS total, round(count(*) FILTER (a = b) * 100.0::DOUBLE / count(*), 1) AS percent FROM (
  SELECT o_orderpriority, o_orderkey % 3 AS a, o_custkey % 3 AS b, o_orderkey % 4 + 1 AS n FROM orders) WHERE n > 1 GROUP BY ROLLUP (o_orderpriority, n)
""")
def stress_check(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("a"), (F.col("o_custkey") % 3).alias("b"), (F.col("o_orderkey") % 4 + 1).alias("syllable_count"))
    return stats.stress_agreement(o, "o_orderpriority", "a", "b").withColumnRenamed("syllable_count", "n")


@query("""
SELECT l_linestatus, coalesce(avg(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "A", coalesce(avg(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "N", coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "R"
FROM (SELECT l_linestatus, l_returnflag, l_quantity FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') >= 2
""".replace("SELECT l_linestatus, coalesce(avg", "SELECT l_linestatus, round(coalesce(avg", 1).replace("'A'), 0)", "'A'), 0), 6)").replace(", coalesce(avg(l_quantity) FILTER (l_returnflag = 'N'), 0)", ", round(coalesce(avg(l_quantity) FILTER (l_returnflag = 'N'), 0), 6)").replace(", coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0)", ", round(coalesce(avg(l_quantity) FILTER (l_returnflag = 'R'), 0), 6)"))
def pivot_bars(spark, d):
    return rounded(stats.pivot_means(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_quantity", F.col("n_R") >= 2), "A", "N", "R")


@query("""
SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS high FROM lineitem GROUP BY 1
""")
def five_numbers(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.five_numbers("l_quantity"))


@query("""
SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'pooled' ELSE r_name END AS grp, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1
UNION ALL SELECT r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def group_pool(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("grp"))
    return stats.group_pool(j, "grp", F.col("grp").isin("ASIA", "EUROPE"), "pooled").groupBy("grp").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT rec, count(*) AS recognized_word_count, round(avg(value / 500.0::DOUBLE), 3) AS mean_word_confidence, count(*) FILTER (value / 500.0::DOUBLE < 0.1::DOUBLE) AS low_confidence_word_count FROM ev GROUP BY rec")
def recognition_diagnostics(spark, d):
    return stats.diagnostics(timed(spark, d).withColumn("c", F.col("value") / 500.0), "rec", "c", 0.1)


@query("SELECT label, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(stddev_pop(x), 6) AS std FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label")
def segment_summary(spark, d):
    e = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rounded(e.groupBy("label").agg(*stats.summary("x")), "mean", "max", "min", "std")


# --- texts -----------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g')), '\s+'), lambda w: w <> '')) AS n FROM documents")
def token_normalize_space(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.spaced_words(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[0-9a-zа-я-]+'), ' ') AS words FROM documents")
def token_normalize_findall(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.found_words(F.col("text")), " ").alias("words"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[aeiouy]')) AS n_vowels, nullif(regexp_extract(lower(text), '[aeiou]', 0), '') AS main_vowel, lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS clean FROM documents")
def vowel_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.vowel_count(t, "aeiouy").cast("long").alias("n_vowels"), text.main_vowel(t, "aeiou").alias("main_vowel"), text.clean_word(t, "a-zA-Z").alias("clean"))


@query()
def syllabify_latin(spark, d):
    w = table(spark, d, "documents").select(F.explode(text.found_words(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.array_join(text.latin_syllables("word"), "-").alias("syllables"))


def _turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", text.found_words(F.col("text")).alias("w"))
    return c.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")


@query()
def wer_by_turn(spark, d):
    """Each turn against the one before it, whole texts."""
    e = _turns(spark, d).select("conv_id", "turn", F.size("before").alias("words"), align.edits("before", "w").alias("e"))
    return stats.wer(e.select("conv_id", "turn", "words", "e.*"), "conv_id", "turn")


@query()
def wer_micro(spark, d):
    return stats.wer(wer_by_turn(spark, d))


@query()
def word_diff(spark, d):
    diff = align.word_diff("before", "w")
    return _turns(spark, d).select("conv_id", "turn", diff.alias("x")).select("conv_id", "turn", *[F.size(f"x.{c}").alias(c) for c in ("correct", "substituted", "missed", "inserted")])


@query()
def sequence_alignment(spark, d):
    """Each turn aligned with the one before it, whole texts: pairs, and words skipped on either side."""
    t = _turns(spark, d)
    a = F.explode(align.aligned("w", "before"))
    return t.select("conv_id", "turn", a.alias("a")).groupBy("conv_id", "turn").agg(F.count_if(F.col("a.system_idx").isNotNull() & F.col("a.ground_idx").isNotNull()).alias("pairs"), F.count_if(F.col("a.ground_idx").isNull()).alias("only_system"), F.count_if(F.col("a.system_idx").isNull()).alias("only_ground"))


# --- windows ---------------------------------------------------------------------------------


@query(f"{WITH} SELECT rec, after, before, round(g, 2) AS duration FROM (SELECT rec, lag(CAST(id AS VARCHAR)) OVER w AS after, CAST(id AS VARCHAR) AS before, t - lag(t) OVER w AS g FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t)) WHERE g >= 86400")
def pauses(spark, d):
    return windows.pauses(timed(spark, d).withColumn("label", F.col("id").cast("string")), "rec", "t", "t", "t", "label", 24 * HOUR)


@query(f"{WITH} SELECT rec, idx, round(least(3600.0::DOUBLE, greatest(0.0::DOUBLE, coalesce((lead(start) OVER (PARTITION BY rec ORDER BY start) - \"end\") * 0.5::DOUBLE, 3600.0::DOUBLE))), 6) AS pad_end FROM cl")
def pad_to_next(spark, d):
    return rounded(windows.pad_to_next(spans(spark, d), "rec", "start", "start", "end", HOUR).select("rec", "idx", "pad_end"), "pad_end")


@query(f"""{WITH}, m AS (SELECT rec, id, t, CAST(value > 40 AS INT) AS v FROM ev)
SELECT rec, id, coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v) >= 2 AS smoothed FROM m WINDOW w AS (PARTITION BY rec ORDER BY t)""")
def median3_mask(spark, d):
    return windows.median3(timed(spark, d).withColumn("m", F.col("value") > 40), "rec", "t", "m").select("rec", "id", "smoothed")


@query(f"""{WITH}, r AS (SELECT rec, t, row_number() OVER (PARTITION BY rec ORDER BY t) AS i, value > 40 AS o FROM ev),
g AS (SELECT rec, t, i - row_number() OVER (PARTITION BY rec ORDER BY t) AS g FROM r WHERE o),
x AS (SELECT rec, min(t) AS first, max(t) AS last, count(*) AS length FROM g GROUP BY rec, g)
SELECT rec, first, last, length FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY length DESC, first) AS n FROM x) WHERE n = 1""")
def longest_run(spark, d):
    return windows.longest_run(timed(spark, d), "rec", "t", F.col("value") > 40)


@query(f"""{WITH} SELECT rec, id, round(greatest(0, value - greatest(min(value) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), min(value) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))), 6) AS prominence FROM ev""")
def local_prominence(spark, d):
    return rounded(windows.local_prominence(timed(spark, d), "rec", "t", "value").select("rec", "id", "prominence"), "prominence")


@query(f"""{WITH}, f AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY t) AS frame, value FROM ev),
p AS (SELECT rec, frame AS a, lead(frame) OVER (PARTITION BY rec ORDER BY frame) AS b FROM f WHERE value > 100)
SELECT rec, a AS from_peak, b AS to_peak, arg_min(frame, (value, frame)) AS valley, min(value) AS energy FROM p JOIN f USING (rec) WHERE b IS NOT NULL AND frame BETWEEN a AND b GROUP BY ALL""")
def adjacent_valley(spark, d):
    f = timed(spark, d).select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("t")).cast("long").alias("frame"), "value")
    return windows.valleys(f, f.filter("value > 100").select("rec", "frame"), "rec", "frame", "value", 20)


@query(f"""{WITH} SELECT rec, id, array_to_string(list_transform([
  coalesce(lag(value, 4) OVER w, first_value(value) OVER w), coalesce(lag(value, 2) OVER w, first_value(value) OVER w), value,
  coalesce(lead(value, 2) OVER w, last_value(value) OVER w), coalesce(lead(value, 4) OVER w, last_value(value) OVER w)], lambda x: CAST(round(x * 100) AS BIGINT)::VARCHAR), ' ') AS context
FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def context_offsets(spark, d):
    out = windows.context(timed(spark, d), "rec", "t", "value", (-4, -2, 0, 2, 4))
    return out.select("rec", "id", F.array_join(F.transform("context", lambda x: F.round(x * 100).cast("long").cast("string")), " ").alias("context"))


@query(f"""{WITH}, w AS (SELECT rec, id, value, avg(value) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, lag(1, 2) OVER v IS NULL OR lead(1, 2) OVER v IS NULL AS edge FROM ev WINDOW v AS (PARTITION BY rec ORDER BY t))
SELECT rec, id, round(CASE WHEN edge THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(value - m) / 40)) END, 6) AS stability FROM w""")
def f0_stability(spark, d):
    return rounded(windows.f0_stability(timed(spark, d), "rec", "t", "value").select("rec", "id", "stability"), "stability")


@query(f"""{WITH}, f AS (SELECT rec, id, row_number() OVER (PARTITION BY rec ORDER BY t) AS frame, event_type FROM ev), p AS (SELECT * FROM f WHERE event_type = 'view')
SELECT rec, id, coalesce(frame - lag(frame) OVER w, 50) AS gap_before, coalesce(lead(frame) OVER w - frame, 50) AS gap_after FROM p WINDOW w AS (PARTITION BY rec ORDER BY frame)""")
def candidate_gaps(spark, d):
    f = timed(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("rec").orderBy("t")).cast("long")).filter("event_type = 'view'")
    return windows.candidate_gaps(f, "rec", "frame").select("rec", "id", F.col("gap_before").cast("long").alias("gap_before"), F.col("gap_after").cast("long").alias("gap_after"))


@query("""SELECT label, vec_id, round(coalesce(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(embedding[i] AS DOUBLE) - CAST(prev[i] AS DOUBLE), 2)))), 0), 6) AS flux
FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)""")
def spectral_flux(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(windows.flux(e, "label", "vec_id", "v").select("label", "vec_id", "flux"), "flux")


# --- intervals -------------------------------------------------------------------------------

NEAREST = f"""{WITH}, j AS (
  SELECT pu.rec, pu.id, pu.t, cl.idx, cl.start, greatest(0.0::DOUBLE, cl.start - pu.t, pu.t - cl."end") AS dist, abs(pu.t - (cl.start + cl."end") / 2) AS off FROM pu JOIN cl ON pu.rec = cl.rec AND pu.t BETWEEN cl.start - 3600 AND cl."end" + 3600
), b AS (SELECT *, row_number() OVER (PARTITION BY rec, id ORDER BY dist, off, idx) AS n FROM j WHERE dist <= 3600)
"""


@query(NEAREST + " SELECT rec, id AS candidate_id, idx AS word_idx, round(t - start, 6) AS time_in_word FROM b WHERE n = 1")
def nearest_interval_assign(spark, d):
    return _assigned(spark, d).filter("word_idx is not null").select("rec", "candidate_id", "word_idx", F.round("time_in_word", 6).alias("time_in_word"))


def _assigned(spark, d):
    c = timed(spark, d, "purchase").select("rec", F.col("id").alias("candidate_id"), "t")
    return intervals.assign_nuclei(spans(spark, d).withColumnRenamed("idx", "word_idx"), c, "rec", HOUR, 3 * HOUR)


@query(NEAREST + " SELECT rec, id AS candidate_id FROM pu WHERE NOT EXISTS (FROM b WHERE b.rec = pu.rec AND b.id = pu.id)")
def unassigned(spark, d):
    return _assigned(spark, d).filter("word_idx is null").select("rec", "candidate_id")


INSIDE = f"{WITH}, j AS (SELECT cl.rec, cl.idx, cl.start, cl.\"end\", pu.id, pu.t, pu.value FROM cl LEFT JOIN pu ON pu.rec = cl.rec AND pu.t BETWEEN cl.start AND cl.\"end\")"


@query(INSIDE + " SELECT rec, idx, count(id) AS n_points, CASE count(id) WHEN 1 THEN 'exactly_one' WHEN 0 THEN 'none' ELSE 'multiple' END AS class FROM j GROUP BY rec, idx")
def containment_count(spark, d):
    return intervals.containment_counts(timed(spark, d, "purchase"), spans(spark, d), "rec", "t", "start", "end", "idx", 3 * HOUR).select("rec", "idx", "n_points", "class")


@query(WITH + " SELECT rec, id FROM pu WHERE NOT EXISTS (FROM cl WHERE cl.rec = pu.rec AND pu.t BETWEEN cl.start AND cl.\"end\")")
def interval_diagnostics(spark, d):
    return intervals.points_in_gaps(timed(spark, d, "purchase"), spans(spark, d), "rec", "t", "start", "end", 3 * HOUR).select("rec", "id")


@query(WITH + " SELECT pu.rec, pu.id, coalesce(string_agg(CAST(cl.idx AS VARCHAR), ' ' ORDER BY CAST(cl.idx AS VARCHAR)), '') AS labels FROM pu LEFT JOIN cl ON pu.rec = cl.rec AND pu.t BETWEEN cl.start AND cl.\"end\" GROUP BY ALL")
def labels_at(spark, d):
    out = intervals.labels_at(timed(spark, d, "purchase"), spans(spark, d).withColumn("label", F.col("idx").cast("string")), "rec", "id", "t", "start", "end", "label", 3 * HOUR)
    return out.select("rec", "id", F.array_join("labels", " ").alias("labels"))


@query(INSIDE + " SELECT rec, idx, round(coalesce(arg_max(t, (value, -t)), (start + \"end\") / 2), 6) AS best_t, count(id) > 0 AS seeded FROM j GROUP BY rec, idx, start, \"end\"")
def best_in_interval(spark, d):
    out = intervals.best_in_interval(timed(spark, d, "purchase"), spans(spark, d), "rec", "t", "value", "start", "end", "idx", 3 * HOUR)
    return rounded(out.select("rec", "idx", "best_t", "seeded"), "best_t")


@query(f"{WITH} SELECT cl.rec, cl.idx, round(coalesce(median(ev.value), 0), 6) AS median FROM cl LEFT JOIN ev ON ev.rec = cl.rec AND ev.t >= cl.start AND ev.t < cl.\"end\" GROUP BY ALL")
def half_open_median(spark, d):
    return rounded(intervals.half_open_median(timed(spark, d), spans(spark, d), "rec", "t", "value", "start", "end", "idx", 3 * HOUR).select("rec", "idx", "median"), "median")


@query(f"""{WITH}, w AS (SELECT ev.rec, ev.id, ev.t, ev.value, cl.idx, cl.quota, row_number() OVER (PARTITION BY ev.rec, ev.id ORDER BY abs(ev.t - (cl.start + cl."end") / 2) / greatest(cl."end" - cl.start, 0.05), cl.idx) AS n FROM ev JOIN cl ON ev.rec = cl.rec AND ev.t BETWEEN cl.start AND cl."end" WHERE ev.event_type <> 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY rec, idx ORDER BY value DESC, t DESC, id DESC) AS k FROM w WHERE n = 1)
SELECT ev.rec, ev.id, r.idx AS word, coalesce(r.k <= r.quota, true) AS kept FROM ev LEFT JOIN r ON ev.rec = r.rec AND ev.id = r.id WHERE ev.event_type <> 'click'""")
def quota_topk(spark, d):
    e = timed(spark, d).filter("event_type <> 'click'")
    return intervals.quota_topk(e, spans(spark, d), "rec", "id", "t", "value", "start", "end", "idx", "quota", 3 * HOUR).select("rec", "id", "word", "kept")


@query(f"{WITH} SELECT pu.rec, pu.id, round(coalesce(max(v.value), -1) + 0.12::DOUBLE * pu.value, 6) AS score FROM pu LEFT JOIN ev v ON v.event_type = 'view' AND v.rec = pu.rec AND abs(v.t - pu.t) <= 3600 GROUP BY pu.rec, pu.id, pu.value")
def band_evidence_score(spark, d):
    v = timed(spark, d, "view").select("rec", F.col("t").alias("vt"), F.col("value").alias("vs"))
    out = intervals.band_evidence(timed(spark, d, "purchase"), v, "rec", "id", "t", "vt", "vs", HOUR, -1.0, 0.12 * F.col("value"))
    return rounded(out.select("rec", "id", "score"), "score")


SPAN0 = "1704672000.0::DOUBLE"  # a week into the data


@query(f"{WITH} SELECT rec, idx, round(greatest(start, {SPAN0}) - {SPAN0}, 6) AS start, round(least(\"end\", {SPAN0} + 604800) - {SPAN0}, 6) AS \"end\" FROM cl WHERE least(\"end\", {SPAN0} + 604800) > greatest(start, {SPAN0})")
def clip_rebase(spark, d):
    return rounded(intervals.clip_rebase(spans(spark, d).select("rec", "idx", "start", "end"), "start", "end", 1704672000.0, 1704672000.0 + 604800), "start", "end")


@query(f"{WITH}, x AS (SELECT *, start - lag(\"end\") OVER (PARTITION BY rec ORDER BY start, \"end\") AS g FROM cl) SELECT rec, idx, CASE WHEN \"end\" <= start THEN 'reversed' WHEN g > 1e-7 THEN 'gap' WHEN g < -1e-7 THEN 'overlap' END AS problem FROM x")
def partition_check(spark, d):
    return intervals.partition_check(spans(spark, d), "rec", "start", "end").select("rec", "idx", "problem")


@query(f"""{WITH}, b AS (SELECT rec, min(start) - 3600 AS xmin, max("end") + 3600 AS xmax FROM cl GROUP BY rec),
r AS (SELECT cl.rec, start, "end", xmin, xmax, greatest(xmin, coalesce(max("end") OVER (PARTITION BY cl.rec ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), xmin)) AS reach FROM cl JOIN b USING (rec)),
o AS (SELECT *, greatest(start, reach) AS a FROM r WHERE "end" > greatest(start, reach) + 1e-7)
SELECT rec, round(a, 6) AS start, round("end", 6) AS "end", 'x' AS label FROM o
UNION ALL SELECT rec, round(reach, 6), round(a, 6), '' FROM o WHERE a - reach > 1e-7
UNION ALL SELECT rec, round(max("end"), 6), round(max(xmax), 6), '' FROM o GROUP BY rec""")
def complete_partition(spark, d):
    s = spans(spark, d).select("rec", "start", "end", F.lit("x").alias("label"))
    b = s.groupBy("rec").agg((F.min("start") - HOUR).alias("xmin"), (F.max("end") + HOUR).alias("xmax"))
    return rounded(intervals.complete_partition(s, b, "rec", "start", "end", "label"), "start", "end")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
g AS (SELECT o_orderkey AS l_orderkey, p, n FROM orders, (VALUES (1, 2), (2, 1), (3, 3)) v(p, n)),
s AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY p) AS hi FROM g)
SELECT i.l_orderkey, i.i AS pos, CAST(s.p AS BIGINT) AS word FROM i JOIN s ON s.l_orderkey = i.l_orderkey AND i.i > s.hi - s.n AND i.i <= s.hi AND s.hi <= (SELECT count(*) FROM i x WHERE x.l_orderkey = i.l_orderkey)
""")
def allocate_positions(spark, d):
    li = table(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long"))
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.expr("array(struct(1L as word, 2L as n), struct(2L as word, 1L as n), struct(3L as word, 3L as n))")).alias("g")).select("l_orderkey", "g.*")
    return intervals.allocate_positions(li.select("l_orderkey", "pos"), g, "l_orderkey", "pos", "word", "n").select("l_orderkey", "pos", "word")


# --- events ----------------------------------------------------------------------------------


@query(f"{WITH} SELECT v.rec, v.id FROM ev v WHERE v.event_type = 'view' AND NOT EXISTS (FROM pu WHERE pu.rec = v.rec AND abs(pu.t - v.t) < 21600)")
def priority_union_first(spark, d):
    return events.first_secondary(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "id", "t", 6 * HOUR).select("rec", "id")


UNION = f"""WITH RECURSIVE ev AS ({EV}), p AS (SELECT rec, id, t FROM ev WHERE event_type = 'purchase'),
s AS (SELECT v.rec, v.id, v.t, row_number() OVER (PARTITION BY v.rec ORDER BY v.t, v.id) AS i FROM ev v WHERE v.event_type = 'view' AND NOT EXISTS (FROM p WHERE p.rec = v.rec AND abs(p.t - v.t) < 21600)),
k AS (
  SELECT rec, i, id, t AS last FROM s WHERE i = 1
  UNION ALL
  SELECT n.rec, n.i, n.id, n.t FROM (SELECT s.rec, s.i, s.id, s.t, row_number() OVER (PARTITION BY s.rec ORDER BY s.i) AS first FROM k JOIN s ON s.rec = k.rec AND s.i > k.i AND s.t - k.last >= 21600) n WHERE n.first = 1
)
SELECT rec, id, 'primary' AS origin FROM p UNION ALL SELECT rec, id, 'secondary' FROM k"""


@query(UNION)
def priority_union_greedy(spark, d):
    return events.priority_union(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "id", "t", 6 * HOUR).select("rec", "id", "origin")


NMS = f"""WITH RECURSIVE ev AS ({EV}), s AS (SELECT rec, id, t, value, row_number() OVER (PARTITION BY rec ORDER BY value DESC, id) AS i FROM ev),
k AS (
  SELECT rec, 0::BIGINT AS i, []::DOUBLE[] AS ts, []::BIGINT[] AS ids FROM (SELECT DISTINCT rec FROM ev)
  UNION ALL
  SELECT k.rec, s.i, CASE WHEN ok THEN list_append(k.ts, s.t) ELSE k.ts END, CASE WHEN ok THEN list_append(k.ids, s.id) ELSE k.ids END
  FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1, LATERAL (SELECT len(list_filter(k.ts, lambda x: abs(x - s.t) < 21600)) = 0 AS ok)
)
SELECT rec, unnest(ids) AS id FROM k WHERE i = (SELECT max(i) FROM s WHERE s.rec = k.rec)"""


@query(NMS)
def nms_greedy(spark, d):
    return events.suppress(timed(spark, d), "rec", "id", "t", "value", 6 * HOUR).select("rec", "id")


@query()
def event_match(spark, d):
    out = events.match_events(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "t", HOUR)
    return rounded(events.rates(out.select("rec", "tp", "fp", "fn", "timing_median")), "precision", "recall", "f1", "timing_median")


MATCH = f"""WITH RECURSIVE ev AS ({EV}),
a AS (SELECT rec, list(t ORDER BY t) AS p FROM ev WHERE event_type = 'purchase' GROUP BY rec), b AS (SELECT rec, list(t ORDER BY t) AS r FROM ev WHERE event_type = 'view' GROUP BY rec),
x AS (SELECT coalesce(a.rec, b.rec) AS rec, coalesce(p, []) AS p, coalesce(r, []) AS r FROM a FULL JOIN b ON a.rec = b.rec),
k AS (
  SELECT rec, 1 AS i, 1 AS j, 0 AS n FROM x
  UNION ALL
  SELECT k.rec, i + CASE WHEN p[i] <= r[j] + 3600 THEN 1 ELSE 0 END, j + CASE WHEN p[i] >= r[j] - 3600 THEN 1 ELSE 0 END, n + CASE WHEN abs(p[i] - r[j]) <= 3600 THEN 1 ELSE 0 END
  FROM k JOIN x ON k.rec = x.rec WHERE i <= len(p) AND j <= len(r)
)
SELECT x.rec, CAST(max(n) AS BIGINT) AS tp, CAST(len(any_value(p)) - max(n) AS BIGINT) AS fp, CAST(len(any_value(r)) - max(n) AS BIGINT) AS fn FROM k JOIN x ON k.rec = x.rec GROUP BY x.rec"""


@query(MATCH)
def event_match_counts(spark, d):
    return events.match_counts(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "t", HOUR)


@query(MATCH.replace("SELECT x.rec, CAST", "SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM (SELECT x.rec, CAST") + ")")
def event_match_pooled(spark, d):
    return rounded(events.pooled(event_match_counts(spark, d)).select("precision", "recall", "f1"), "precision", "recall", "f1")


@query()
def cluster_events(spark, d):
    return events.cluster_events(timed(spark, d), "rec", "t", "event_type", 3 * HOUR, 2, 6 * HOUR)


@query()
def word_quota_events(spark, d):
    w = spans(spark, d).select("rec", "start", "end", F.col("quota").alias("count"))
    v, p = (timed(spark, d, k).select("rec", "t", F.col("value").alias("score")) for k in ("view", "purchase"))
    return events.word_quota_events(v, p, w, "rec", HOUR)


# --- grids, ranks, sets ----------------------------------------------------------------------


@query(f"""{WITH}, g AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS grid_idx, a, b FROM (VALUES (20), (50), (100)) x(a), (VALUES (3600), (7200)) y(b)),
c AS (SELECT grid_idx, count(*) FILTER (value >= a AND event_type = 'purchase') AS tp, count(*) FILTER (value >= a AND event_type <> 'purchase') AS fp, count(*) FILTER (value < a AND event_type = 'purchase') AS fn FROM ev, g GROUP BY grid_idx)
SELECT grid_idx, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, row_number() OVER (ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, grid_idx) AS rank FROM c""")
def grid_sweep_rank(spark, d):
    g = ranking.grid(spark, a=[20, 50, 100], b=[3600, 7200])
    e, hit = timed(spark, d).crossJoin(F.broadcast(g)), F.col("event_type") == "purchase"  # six literal rows
    c = e.groupBy("grid_idx").agg(F.count_if((F.col("value") >= F.col("a")) & hit).alias("tp"), F.count_if((F.col("value") >= F.col("a")) & ~hit).alias("fp"), F.count_if((F.col("value") < F.col("a")) & hit).alias("fn"))
    r = events.rates(c).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "grid_idx")).cast("long"))
    return rounded(r.select("grid_idx", "tp", "fp", "fn", "f1", "rank"), "f1")


@query("""
WITH f AS (SELECT DISTINCT o_orderpriority AS fold FROM orders)
SELECT fold, count(*) FILTER (o_orderpriority <> fold) AS n_train, round(avg(o_totalprice) FILTER (o_orderpriority <> fold), 4) AS train_mean, round(avg(o_totalprice) FILTER (o_orderpriority = fold), 4) AS test_mean FROM orders, f GROUP BY fold
""")
def leave_one_out(spark, d):
    x = ranking.leave_one_out(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority")
    tr = F.col("role") == "train"
    return x.groupBy("fold").agg(F.count_if(tr).alias("n_train"), F.round(F.avg(F.when(tr, F.col("o_totalprice"))), 4).alias("train_mean"), F.round(F.avg(F.when(~tr, F.col("o_totalprice"))), 4).alias("test_mean"))


COSINE = """
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), j AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-8), 12) AS cosine FROM q a, q b WHERE a.vec_id <> b.vec_id)
SELECT a, b, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS n FROM j) WHERE n <= MOST
"""


@query(COSINE.replace("MOST", "5"))
def cosine_topk(spark, d):
    """The five nearest of every vector: all rows are queries, met in blocks."""
    return rounded(ranking.cosine_neighbours(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), 5), "cosine")


@query(COSINE.replace("MOST", "20"))
def cosine_topk_all(spark, d):
    return rounded(ranking.cosine_neighbours(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), 20), "cosine")


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'missing', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
""")
def set_ops(spark, d):
    c, s, n = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(c.intersect(s), "both").unionByName(count(n.join(s, "k", "left_anti"), "missing")).unionByName(count(c.union(s).distinct(), "either"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS number FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)")
def export_limit(spark, d):
    out = ranking.top(table(spark, d, "documents"), 10, F.desc("n_chars"), F.col("doc_id"))
    return out.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("number"))


@query("SELECT doc_id, text, '\"' || replace(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' '), '\"', '\"\"') || '\"' AS quoted FROM benchmark_docs".replace("benchmark_docs", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def grid_quote(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("doc_id"), "text", F.concat(F.lit('"'), text.grid_quote(F.coalesce("text", F.lit(""))), F.lit('"')).alias("quoted"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
