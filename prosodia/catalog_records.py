"""More operators as queries: nested analysis records, rules over words and marks, choices, small numeric functions.

``orders`` play words of a recording (customer) and ``lineitem`` their syllables, nested into the record
that tools exchange; see ``analyses``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prosodia.catalog import EV, HOUR, NEAREST, UNION, WITH, query, rounded, spans, table, timed
from prosodia.functions import arrays, text
from prosodia.operators import events, intervals, ranking, records, stats, windows
from prosodia.plans import reduction
from prosodia.sources import files
from prosodia.streaming import windows as streams

CORE_OR = "CASE WHEN is_core THEN {} ELSE {} END"
#: One row a syllable, as ``analyses`` nests them.
REC = """WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS syl_idx FROM lineitem),
s AS (SELECT o_custkey AS recording_id, o_orderkey AS k, o_orderstatus AS st, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS word_idx, syl_idx,
  count(*) OVER (PARTITION BY o_orderkey) AS n, CASE l_returnflag WHEN 'A' THEN 'ба' WHEN 'N' THEN 'тн' ELSE 'ре' END AS syllable, (o_orderkey % 1000)::DOUBLE AS ws,
  l_linestatus = 'O' AS is_core, l_quantity AS q, l_extendedprice AS p, l_discount AS dc, l_tax AS tx FROM li JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, coalesce(CASE WHEN k % 4 < 3 THEN k % 4 END, CASE WHEN k % 8 = 3 THEN 1 END, -1) AS stressed, coalesce(CASE WHEN k % 5 > 0 THEN k % 3 END, -1) AS expected,
  n + CASE WHEN k % 7 > 0 THEN k % 2 ELSE 0 END AS syllable_count, CASE WHEN is_core THEN q / 200 ELSE q / 400 END AS duration, CASE WHEN is_core THEN tx ELSE dc / 10 END AS energy,
  CASE WHEN is_core THEN q - 3 ELSE q - 5 END AS central FROM s),
y AS (SELECT *, CASE WHEN syl_idx = stressed THEN 'stressed' WHEN syl_idx = stressed - 1 THEN 'pretonic' WHEN syl_idx = stressed + 1 THEN 'posttonic' ELSE 'other_unstressed' END AS position FROM r),
w AS (SELECT DISTINCT recording_id, word_idx, k, st, n, ws, stressed, expected, syllable_count FROM r)
"""
MEASURED = REC + """, m AS (SELECT *, CASE syllable WHEN 'ба' THEN 'а' WHEN 'ре' THEN 'е' END AS vowel FROM y
  WHERE duration >= CASE WHEN is_core THEN 0.025::DOUBLE ELSE 0.040::DOUBLE END AND central >= 0 AND stressed >= 0 AND stressed < syllable_count AND syllable_count > 1 AND syllable <> 'тн')
"""


def analyses(spark, d):
    """recording_id and wordAnalysis in the schema of the record, through its JSON form."""
    k, q = F.col("o_orderkey"), F.col("l_quantity")
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1)
    unit = F.when(F.col("l_returnflag") == "A", "ба").when(F.col("l_returnflag") == "N", "тн").otherwise("ре")
    core = F.when(F.col("l_linestatus") == "O", F.struct((q / 200).alias("duration"), F.col("l_tax").alias("energyMean"), (q - 3).alias("central"), F.lit(0.05).alias("startInSyl"), F.lit(0.1).alias("endInSyl")))
    acoustics = F.struct((q / 400).alias("duration"), (F.col("l_discount") / 10).alias("energyMean"), (q - 5).alias("central"), F.array(q * 20, F.col("l_extendedprice") / 50).alias("formants"), core.alias("core"))
    one = F.struct(F.col("i"), unit.alias("syllable"), (F.col("i") * 0.25).alias("startSec"), (F.col("i") * 0.25 + 0.2).alias("endSec"), acoustics.alias("acoustics"))
    syl = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("syllableAnalysis"))
    o = table(spark, d, "orders").join(syl, F.col("l_orderkey") == k)
    n = F.size("syllableAnalysis")
    word = F.struct(
        k.alias("k"), F.concat(F.lit("w"), k).alias("word"), (k % 1000).cast("double").alias("start"), ((k % 1000) + n * 0.25 - 0.1).alias("end"),
        F.when(k % 4 < 3, k % 4).alias("actualStressedIdx"), F.when(k % 8 == 3, 1).alias("stressedIdx"), F.when(k % 5 > 0, k % 3).alias("expectedStressedIdx"),
        F.when(k % 7 > 0, n + k % 2).alias("syllableCount"), F.when(k % 11 > 0, k % 6 == 0).alias("countMismatch"), (F.col("o_orderstatus") == "F").alias("hasIssue"),
        F.struct((k % 9 == 0).alias("hasReductionIssue")).alias("reductionInfo"), "syllableAnalysis",
    )
    nested = o.groupBy(F.col("o_custkey").alias("recording_id")).agg(F.array_sort(F.collect_list(word)).alias("wordAnalysis"))
    return nested.select("recording_id", F.from_json(F.to_json(F.struct("wordAnalysis")), records.RECORD).alias("r")).select("recording_id", "r.*")


@query(REC + "SELECT recording_id, CAST(word_idx AS INT) AS word_idx, 'w' || k AS word, CAST(stressed AS INT) AS stressed, CAST(expected AS INT) AS expected, CAST(syllable_count AS INT) AS syllable_count FROM w")
def record_words(spark, d):
    return records.words(analyses(spark, d)).select("recording_id", "word_idx", "word", "stressed", "expected", "syllable_count")


@query(REC + """SELECT recording_id, CAST(word_idx AS INT) AS word_idx, CAST(syl_idx AS INT) AS syl_idx, syllable, round(ws + syl_idx * 0.25::DOUBLE, 6) AS start, round(duration, 6) AS duration, round(energy, 6) AS energy,
  round(central, 6) AS central, is_core, position FROM y""")
def record_syllables(spark, d):
    s = records.syllables(records.words(analyses(spark, d)))
    return rounded(s.select("recording_id", "word_idx", "syl_idx", "syllable", "start", "duration", "energy", "central", "is_core", "position"), "start", "duration", "energy", "central")


@query(REC + "SELECT recording_id, CAST(word_idx AS INT) AS word_idx, bool_and(is_core) AS all_cores FROM r GROUP BY ALL")
def cores_of_whole_words(spark, d):
    return records.words(analyses(spark, d)).select("recording_id", "word_idx", records.all_cores(F.col("syllableAnalysis")).alias("all_cores"))


@query(MEASURED + "SELECT recording_id, vowel, position, count(*) AS n, round(avg(duration), 9) AS duration, round(avg(energy), 9) AS energy, round(avg(central), 9) AS central FROM m GROUP BY ALL")
def measurable_syllables(spark, d):
    m = reduction.measures(analyses(spark, d)).groupBy("recording_id", "vowel", "position")
    return m.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("duration", "energy", "central")])


@query(MEASURED + """SELECT vowel, position, count(*) AS n, round(min(duration), 6) AS low, round(quantile_cont(duration, 0.25), 6) AS q25, round(quantile_cont(duration, 0.5), 6) AS q50, round(quantile_cont(duration, 0.75), 6) AS q75, round(max(duration), 6) AS high
  FROM m GROUP BY ALL HAVING count(*) >= 10""")
def duration_boxes(spark, d):
    return rounded(reduction.boxes(reduction.measures(analyses(spark, d))), "low", "q25", "q50", "q75", "high")


@query(REC + "SELECT recording_id, CAST(word_idx AS INT) AS word_idx, CAST(syl_idx AS INT) AS syl_idx, round(ws + syl_idx * 0.25::DOUBLE, 6) AS start, round(least(ws + n * 0.25::DOUBLE - 0.1::DOUBLE, ws + syl_idx * 0.25::DOUBLE + 0.2::DOUBLE), 6) AS \"end\", syllable AS text FROM r")
def hint_intervals(spark, d):
    return rounded(intervals.hint_intervals(analyses(spark, d), "recording_id"), "start", "end")


@query(REC + "SELECT recording_id, CAST(word_idx AS INT) AS word_idx, CAST(syl_idx AS INT) AS syl_idx, syllable AS label, round(q * 20, 4) AS f1, round(p / 50, 4) AS f2, syl_idx = stressed AS is_stressed FROM r WHERE q * 20 >= 100 AND p / 50 >= 500")
def formant_points(spark, d):
    return rounded(records.formant_points(records.words(analyses(spark, d))), "f1", "f2", places=4)


@query(REC + """SELECT recording_id, CAST(word_idx AS INT) AS word_idx, 'word' AS layer, 1::BIGINT AS n, round(ws, 4) AS start FROM w
UNION ALL SELECT recording_id, CAST(word_idx AS INT), 'syllable', count(*), round(min(ws + syl_idx * 0.25::DOUBLE), 4) FROM r GROUP BY ALL
UNION ALL SELECT recording_id, CAST(word_idx AS INT), 'core', count(*), round(min(ws + syl_idx * 0.25::DOUBLE + 0.05::DOUBLE), 4) FROM r WHERE is_core GROUP BY ALL""")
def word_plot_layers(spark, d):
    return records.word_plot(records.words(analyses(spark, d))).groupBy("recording_id", "word_idx", "layer").agg(F.count("*").alias("n"), F.round(F.min("start"), 4).alias("start"))


@query(REC + """SELECT recording_id, count(*) AS words, count(*) FILTER (st <> 'F') AS good_words, count(*) FILTER (stressed >= 0 AND expected >= 0 AND syllable_count > 1 AND stressed = expected) AS stress_matches,
  count(*) FILTER (stressed >= 0 AND expected >= 0 AND syllable_count > 1) AS stress_known, count(*) FILTER (k % 9 = 0) AS reduction_issues FROM w GROUP BY 1""")
def report_summary(spark, d):
    return records.summary(records.words(analyses(spark, d)))


@query(REC + """, a AS (SELECT recording_id, avg(CASE WHEN energy < 0.004::DOUBLE THEN 0 ELSE 1 END) AS loud, avg(CAST(is_core AS INT)) AS core FROM y GROUP BY 1),
b AS (SELECT recording_id, avg(CASE WHEN k % 11 > 0 AND k % 6 = 0 THEN 0 ELSE 1 END) AS cnt, avg(CASE WHEN stressed >= 0 AND expected >= 0 AND syllable_count > 1 THEN CAST(stressed = expected AS INT) END) AS stress, count(*) AS words FROM w GROUP BY 1),
v AS (SELECT recording_id, syllable, avg(duration) FILTER (position = 'stressed') AS a, avg(duration) FILTER (position <> 'stressed') AS b, count(*) FILTER (position = 'stressed') AS na, count(*) FILTER (position <> 'stressed') AS nb
  FROM y WHERE duration >= 0.025::DOUBLE AND stressed >= 0 AND syllable_count > 1 AND syllable <> 'тн' GROUP BY ALL HAVING na >= 3 AND nb >= 3 AND a > 0),
x AS (SELECT recording_id, avg(least(b / a, 1.5::DOUBLE)) AS ratio FROM v GROUP BY 1)
SELECT b.recording_id, round(100 * (0.2::DOUBLE * loud + 0.4::DOUBLE * core + 0.4::DOUBLE * cnt), 1) AS syllable_acoustics, round(100 * stress, 1) AS stress_match,
  round(CASE WHEN ratio IS NOT NULL THEN greatest(20.0::DOUBLE, least(100.0::DOUBLE, 100 - (ratio - 0.70::DOUBLE) / 0.30::DOUBLE * 60)) END, 1) AS vowel_reduction,
  round(greatest(0.0::DOUBLE, 100 * (1 - 0.5::DOUBLE * abs(words / 4.0::DOUBLE - 3) / 3)), 1) AS speech_tempo
FROM b JOIN a USING (recording_id) LEFT JOIN x USING (recording_id)""")
def component_scores(spark, d):
    w = records.words(analyses(spark, d))
    return records.scores(w, records.syllables(w), w.groupBy("recording_id").agg((F.count("*") / 4.0).alias("rate")))


# --- rules over words and marks --------------------------------------------------------------


@query(f"""{WITH}, p AS (SELECT rec, idx, start, "end", least(3600.0::DOUBLE, greatest(0.0::DOUBLE, coalesce((lead(start) OVER (PARTITION BY rec ORDER BY start) - "end") * 0.5::DOUBLE, 3600.0::DOUBLE))) AS pad FROM cl)
SELECT rec, idx FROM p WHERE "end" + pad - start >= 9000""")
def drop_short_words(spark, d):
    padded = windows.pad_to_next(spans(spark, d), "rec", "start", "start", "end", HOUR)
    return windows.drop_short(padded, "start", "end", "pad_end", 2.5 * HOUR).select("rec", "idx")


@query("SELECT doc_id, regexp_replace(lower(trim(text)), '[^0-9a-zа-яё-]', '', 'g') AS clean FROM documents")
def recognised_tokens_cleaned(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_recognised(F.col("text")).alias("clean"))


@query("""SELECT doc_id, t SIMILAR TO '(.|\n)*[аеёиоуыэюя](.|\n)*' AS vowel, nullif(regexp_extract(t, '[аоеия]', 0), '') AS scored, nullif(regexp_extract(t, '[аеёиоуыэюя]', 0), '') AS first_vowel, regexp_matches(t, '[аоеяи]') AS reducible,
  CASE WHEN doc_id % 3 = 0 THEN greatest(doc_id % 5, 0) WHEN t <> '' THEN len(regexp_extract_all(t, '[аеёиоуыэюя]')) ELSE 7 END AS nuclei
FROM (SELECT doc_id, lower(translate(coalesce(text, ''), 'aoeyi', 'аоеуи')) AS t FROM documents)""".replace("t SIMILAR TO '(.|\n)*[аеёиоуыэюя](.|\n)*'", "regexp_matches(t, '[аеёиоуыэюя]')"))
def vowel_rules(spark, d):
    t = F.translate(F.coalesce("text", F.lit("")), "aoeyi", "аоеуи")
    n = text.nucleus_count(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5), t, F.lit(7))
    return table(spark, d, "documents").select("doc_id", text.has_vowel(t).alias("vowel"), records.scored_vowel(t).alias("scored"), text.main_vowel(t).alias("first_vowel"), records.reducible(t).alias("reducible"), n.cast("long").alias("nuclei"))


@query("""SELECT o_orderkey, coalesce(bool_or(l_discount > 0.09::DOUBLE), false) OR o_orderstatus = 'P' OR coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 = 0 END, false) OR o_custkey % 13 = 0 AS issue
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey""")
def word_issues(spark, d):
    bad = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") > 0.09).alias("bad"))
    o = table(spark, d, "orders").join(bad, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", records.word_issue(F.col("bad"), F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5 == 0), F.col("o_custkey") % 13 == 0).alias("issue"))


@query("SELECT l_orderkey, count(*) FILTER (l_discount < 0.004::DOUBLE) AS quiet, count(*) FILTER (l_linenumber % 4 - 1 = l_orderkey % 4 - 1 AND l_linenumber % 4 - 1 >= 0 AND l_orderkey % 4 - 1 >= 0) AS matches FROM lineitem GROUP BY 1")
def quiet_and_matching(spark, d):
    a, b = F.col("l_linenumber") % 4 - 1, F.col("l_orderkey") % 4 - 1
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(records.quiet(F.col("l_discount"))).alias("quiet"), F.count_if(records.stress_match(a, b)).alias("matches"))


MARKS = f"{WITH}, mk AS (SELECT rec, id, t, CASE WHEN value > 80 THEN '' WHEN value > 60 THEN '?' ELSE event_type END AS mark FROM ev), hid AS (SELECT rec, id, CASE WHEN t > 1704672000 THEN '?' ELSE mark END AS mark FROM mk)"


def _marks(spark, d):
    mark = F.when(F.col("value") > 80, "").when(F.col("value") > 60, "?").otherwise(F.col("event_type"))
    return records.hide_after(timed(spark, d).withColumn("mark", mark), "t", "mark", 1704672000.0)


@query(MARKS + " SELECT * FROM hid")
def marks_hidden_after(spark, d):
    return _marks(spark, d).select("rec", "id", "mark")


@query(MARKS + " SELECT rec, id FROM hid WHERE trim(mark) <> '' AND NOT contains(mark, '?')")
def marks_confirmed(spark, d):
    return records.confirmed(_marks(spark, d)).select("rec", "id")


@query(f"{WITH} SELECT rec, id, replace(event_type, 'u', 'U') AS raw, lower(event_type) AS word FROM ev WHERE NOT (value / 1000.0::DOUBLE < 0.080::DOUBLE AND value / 100.0::DOUBLE < 0.85::DOUBLE)")
def short_uncertain_tokens(spark, d):
    e = timed(spark, d).select("rec", "id", F.translate("event_type", "u", "U").alias("raw"), F.translate("event_type", "u", "U").alias("word"), F.lit(0.0).alias("start"), (F.col("value") / 1000.0).alias("end"), (F.col("value") / 100.0).alias("conf"))
    return records.whisper_tokens(e).select("rec", "id", "raw", "word")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_discount < 0.02::DOUBLE THEN -1 ELSE round(sqrt(pow(l_quantity * 20 - 500, 2) + pow(l_extendedprice / 47 - 1500, 2)), 1) END AS central, l_quantity * 20 >= 100 AND l_extendedprice / 47 >= 500 AS plausible FROM lineitem")
def formant_rules(spark, d):
    f1, f2 = F.when(F.col("l_discount") >= 0.02, F.col("l_quantity") * 20), F.col("l_extendedprice") / 47
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", arrays.centralization(f1, f2).alias("central"), arrays.plausible_formants(F.array(F.col("l_quantity") * 20, f2)).alias("plausible"))


@query("""SELECT CAST(l_linenumber AS INT) AS l_linenumber, CASE WHEN l_linenumber = l_orderkey % 6 THEN 'stressed' WHEN l_linenumber = l_orderkey % 6 - 1 THEN 'pretonic' WHEN l_linenumber = l_orderkey % 6 + 1 THEN 'posttonic' ELSE 'other_unstressed' END AS position, count(*) AS n FROM lineitem GROUP BY ALL""")
def position_labels(spark, d):
    return table(spark, d, "lineitem").select("l_linenumber", stats.position_label(F.col("l_linenumber"), F.col("l_orderkey") % 6).alias("position")).groupBy("l_linenumber", "position").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  CASE WHEN l_quantity < 10 OR l_linenumber = 7 THEN 'N<10' WHEN l_discount < 0.001::DOUBLE THEN '***' WHEN l_discount < 0.01::DOUBLE THEN '**' WHEN l_discount < 0.05::DOUBLE THEN '*' ELSE 'n.s.' END AS sig,
  CASE WHEN l_quantity < 10 THEN 'descriptive' WHEN l_discount < 0.05::DOUBLE AND l_quantity / 50 < 0.80::DOUBLE AND l_tax < 0.05::DOUBLE AND l_extendedprice / 100000 < 0.85::DOUBLE THEN 'strong'
       WHEN (l_discount < 0.05::DOUBLE AND l_quantity / 50 < 0.90::DOUBLE) OR (l_tax < 0.05::DOUBLE AND l_extendedprice / 100000 < 0.92::DOUBLE) THEN 'moderate' ELSE 'not proven' END AS verdict FROM lineitem""")
def verdict_rules(spark, d):
    p, enough = F.when(F.col("l_linenumber") != 7, F.col("l_discount")), F.col("l_quantity") >= 10
    v = stats.verdict(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_extendedprice") / 100000, F.col("l_tax"), enough)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", stats.significance(p, enough).alias("sig"), v.alias("verdict"))


@query("""SELECT l_returnflag, CAST(sum(w) AS BIGINT) AS words, CAST(sum(s) AS BIGINT) AS s, CAST(sum(de) AS BIGINT) AS d, CAST(sum(i) AS BIGINT) AS i, round((sum(s) + sum(de) + sum(i)) * 100.0::DOUBLE / sum(w), 2) AS wer
FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS w, l_linenumber % 3 AS s, l_orderkey % 4 AS de, l_partkey % 2 AS i FROM lineitem) GROUP BY 1""")
def wer_totals(spark, d):
    e = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("words"), (F.col("l_linenumber") % 3).cast("long").alias("s"), (F.col("l_orderkey") % 4).alias("d"), (F.col("l_partkey") % 2).alias("i"))
    return stats.wer(e, "l_returnflag")


# --- spans, evidence, choices ----------------------------------------------------------------

SPAN = f"{WITH}, sp AS (SELECT rec, min(start) AS a, max(\"end\") AS b FROM cl WHERE quota <> 1 GROUP BY rec), sp2 AS (SELECT rec, coalesce(sp.a, c.a) AS a, coalesce(sp.b, c.b) AS b FROM (SELECT rec, min(start) AS a, max(\"end\") AS b FROM cl GROUP BY rec) c LEFT JOIN sp USING (rec))"


def _span(spark, d):
    i = spans(spark, d).select("rec", "start", "end", F.when(F.col("quota") != 1, "x").otherwise(" ").alias("text"))
    return intervals.annotation_span(i, timed(spark, d, "click").select("rec", "t"), "rec")


@query(SPAN + " SELECT rec, round(a, 6) AS span_start, round(b, 6) AS span_end FROM sp2")
def annotation_spans(spark, d):
    return rounded(_span(spark, d), "span_start", "span_end")


@query(SPAN + " SELECT pu.rec, pu.id FROM pu JOIN sp2 ON pu.rec = sp2.rec AND pu.t BETWEEN a AND b")
def points_within_span(spark, d):
    return intervals.within_span(timed(spark, d, "purchase"), _span(spark, d), "rec", "t").select("rec", "id")


@query(SPAN + " SELECT cl.rec, idx, round(greatest(start, a), 6) AS start, round(least(\"end\", b), 6) AS \"end\" FROM cl JOIN sp2 ON cl.rec = sp2.rec AND \"end\" > a AND start < b")
def intervals_cut_to_span(spark, d):
    return rounded(intervals.overlapping(spans(spark, d), _span(spark, d), "rec").select("rec", "idx", "start", "end"), "start", "end")


@query(f"{WITH}, j AS (SELECT cl.rec, cl.idx, cl.start, cl.\"end\", pu.id, pu.t, pu.value FROM cl LEFT JOIN pu ON pu.rec = cl.rec AND pu.t BETWEEN cl.start AND cl.\"end\") SELECT rec, idx AS segment_id, round(coalesce(arg_max(t, (value, -t)), (start + \"end\") / 2), 6) AS t FROM j GROUP BY rec, idx, start, \"end\"")
def segment_peaks(spark, d):
    peaks = timed(spark, d, "purchase").withColumnRenamed("value", "confidence")
    return rounded(intervals.segment_events(spans(spark, d).withColumnRenamed("idx", "segment_id"), peaks, "rec", "peak", 3 * HOUR), "t")


@query(f"{WITH} SELECT rec, idx AS segment_id, round((start + \"end\") / 2, 6) AS t FROM cl")
def segment_midpoints(spark, d):
    return rounded(intervals.segment_events(spans(spark, d).withColumnRenamed("idx", "segment_id"), timed(spark, d), "rec", "midpoint"), "t")


@query(NEAREST + ", a AS (SELECT pu.rec, sqrt(pu.value) AS value, b.id IS NOT NULL AS has FROM pu LEFT JOIN b ON b.rec = pu.rec AND b.id = pu.id AND b.n = 1) SELECT rec, count(*) AS count, count(*) FILTER (has) AS assigned, count(*) FILTER (NOT has) AS unassigned, round(avg(value), 3) AS mean_confidence FROM a GROUP BY rec")
def candidate_summary(spark, d):
    c = timed(spark, d, "purchase").select("rec", F.col("id").alias("candidate_id"), "t", F.sqrt("value").alias("confidence"))
    a = intervals.assign_nuclei(spans(spark, d).withColumnRenamed("idx", "word_idx"), c.drop("confidence"), "rec", HOUR, 3 * HOUR)
    return stats.candidate_diagnostics(a.join(c.select("rec", "candidate_id", "confidence"), ["rec", "candidate_id"]), "rec")


@query(f"""{WITH}, s AS (SELECT rec, list(start ORDER BY start) AS a, list("end" ORDER BY start) AS e FROM cl GROUP BY rec), t AS (SELECT rec, list(t ORDER BY t) AS b FROM pu GROUP BY rec),
j AS (SELECT s.rec, a, e, b FROM s JOIN t USING (rec) WHERE len(a) = len(b))
SELECT rec, round(unnest(list_concat(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]) * 1000), [abs(e[-1] - b[-1] - 3600) * 1000])), 3) AS error_ms FROM j""")
def unit_boundary_errors(spark, d):
    pack = lambda df, end: df.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start", end.alias("end")))).alias("u"))
    found = pack(spans(spark, d), F.col("end")).withColumnRenamed("u", "found")
    truth = pack(timed(spark, d, "purchase").withColumnRenamed("t", "start"), F.col("start") + HOUR).withColumnRenamed("u", "truth")
    return rounded(stats.boundary_errors(found.join(truth, "rec"), ["rec"], "found", "truth"), "error_ms", places=3)


@query("""SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_custkey, -o_orderkey)) AS grid_idx, max(o_totalprice) AS k0 FROM orders GROUP BY 1""")
def best_settings(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "grid_idx")
    return ranking.first_best(o, ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_custkey")]).select("o_orderpriority", "grid_idx", "k0")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 1")
def best_eligible_setting(spark, d):
    return ranking.eligible_best(table(spark, d, "orders"), F.col("o_orderstatus") == "P", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS number FROM customer QUALIFY number <= 25")
def numbered_export(spark, d):
    return ranking.export_limit(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 25).select("c_custkey", F.col("number").cast("long").alias("number"))


def _axes(axes):
    names = list(axes)
    tables = ", ".join(f"(SELECT unnest({v}::DOUBLE[]) AS {k}, unnest(range({len(v)})) AS i_{k})" for k, v in axes.items())
    index = f"row_number() OVER (ORDER BY {', '.join('i_' + k for k in names)}) - 1"
    return f"SELECT {index} AS grid_idx, {', '.join(names)} FROM {tables}"


def _passing(spark, d, axes, scale):
    """How many events pass every bound of each setting: counted once by what they pass, then summed over the settings."""
    e = timed(spark, d).select(*[scale[c].alias(f"v_{c}") for c in axes])
    passed = lambda c, values: sum(((F.col(f"v_{c}") >= v).cast("int") for v in values[1:]), (F.col(f"v_{c}") >= values[0]).cast("int"))
    steps = [passed(c, values).alias(f"n_{c}") for c, values in axes.items()]
    # a row for each combination of steps that events reach, at most as many as there are settings and one more an axis
    reached = e.select(*steps).groupBy(*[f"n_{c}" for c in axes]).agg(F.count("*").alias("n"))
    settings = ranking.grid(spark, **axes)
    for c, values in axes.items():
        settings = settings.withColumn(f"s_{c}", F.array_position(F.array(*[F.lit(float(v)) for v in values]), F.col(c)))
    on = [F.col(f"n_{c}") >= F.col(f"s_{c}") for c in axes]
    counted = settings.join(F.broadcast(reached), on, "left").groupBy("grid_idx").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("passed"))
    return settings.select("grid_idx", *axes).join(counted, "grid_idx")


def _passing_sql(axes, scale):
    bounds = " AND ".join(f"{scale[c]} >= g.{c}" for c in axes)
    return f"{WITH}, g AS ({_axes(axes)}) SELECT g.grid_idx, {', '.join(f'g.{c}' for c in axes)}, (SELECT count(*) FROM ev WHERE {bounds}) AS passed FROM g"


_CONTOUR = {"dip_db": "ev.value / 20", "distance_s": "(ev.id % 15) / 100.0::DOUBLE", "gain_db": "ev.value / 15", "floor_db": "ev.value / 2"}
_SEGMENT = {"norm": "ev.value / 50", "merge": "(ev.id % 100) / 100.0::DOUBLE"}


@query(_passing_sql(ranking.CONTOUR_AXES, _CONTOUR))
def contour_grid(spark, d):
    v, i = F.col("value"), F.col("id")
    return _passing(spark, d, ranking.CONTOUR_AXES, {"dip_db": v / 20, "distance_s": (i % 15) / F.lit(100.0), "gain_db": v / 15, "floor_db": v / 2})


@query(_passing_sql(ranking.SEGMENT_AXES, _SEGMENT))
def segment_grid(spark, d):
    return _passing(spark, d, ranking.SEGMENT_AXES, {"norm": F.col("value") / 50, "merge": (F.col("id") % 100) / F.lit(100.0)})


@query(f"{WITH}, g AS ({_axes(ranking.GATE_AXES)}) SELECT grid_idx, count(*) AS passed FROM ev JOIN g ON ev.id % 17 = 0 OR (value / 200 >= periodicity AND value / 150 >= strength AND (ev.id % 10) / 10.0::DOUBLE >= vowel) GROUP BY grid_idx")
def gate_sweep(spark, d):
    c = timed(spark, d).select("id", (F.col("id") % 17 == 0).alias("weak_recovery"), (F.col("value") / 200).alias("periodicity"), (F.col("value") / 150).alias("strength"), ((F.col("id") % 10) / 10.0).alias("vowel_likeness"))
    return ranking.gate(c, ranking.grid(spark, **ranking.GATE_AXES)).groupBy("grid_idx").agg(F.count("*").alias("passed"))


# --- unions of events ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE ev AS ({EV}), p AS (SELECT rec, id, t FROM ev WHERE event_type = 'purchase'),
s AS (SELECT v.rec, v.id, v.t, row_number() OVER (PARTITION BY v.rec ORDER BY v.value DESC, v.id) AS i FROM ev v WHERE v.event_type = 'view' AND NOT EXISTS (FROM p WHERE p.rec = v.rec AND abs(p.t - v.t) < 21600)),
k AS (
  SELECT rec, 0::BIGINT AS i, []::DOUBLE[] AS ts, []::BIGINT[] AS ids FROM (SELECT DISTINCT rec FROM s)
  UNION ALL
  SELECT k.rec, s.i, CASE WHEN ok THEN list_append(k.ts, s.t) ELSE k.ts END, CASE WHEN ok THEN list_append(k.ids, s.id) ELSE k.ids END
  FROM k JOIN s ON s.rec = k.rec AND s.i = k.i + 1, LATERAL (SELECT len(list_filter(k.ts, lambda x: abs(x - s.t) < 21600)) = 0 AS ok)
)
SELECT rec, id, 'primary' AS origin FROM p UNION ALL SELECT rec, unnest(ids), 'secondary' FROM k WHERE i = (SELECT max(i) FROM s WHERE s.rec = k.rec)""")
def rescue_by_score(spark, d):
    return events.priority_union(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "id", "t", 6 * HOUR, by="value").select("rec", "id", "origin")


@query(UNION.replace("event_type = 'purchase'", "event_type = 'X'").replace("event_type = 'view'", "event_type = 'purchase'").replace("event_type = 'X'", "event_type = 'view'"))
def combined_second_first(spark, d):
    return events.combined(timed(spark, d, "purchase"), timed(spark, d, "view"), "second_priority", "rec", "id", "t", 6 * HOUR).select("rec", "id", "origin")


@query(f"{WITH} SELECT rec, id, 'secondary' AS origin FROM ev WHERE event_type = 'view'")
def combined_standalone(spark, d):
    return events.combined(timed(spark, d, "purchase"), timed(spark, d, "view"), "standalone", "rec", "id", "t", 6 * HOUR).select("rec", "id", "origin")


# --- numbers and arrays ----------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(CASE WHEN max(l_quantity) OVER p - min(l_quantity) OVER p <= 1e-9 THEN 0 ELSE (l_quantity - min(l_quantity) OVER p) / (max(l_quantity) OVER p - min(l_quantity) OVER p) END, 6) AS scaled,
  round(1 / (1 + exp(-greatest(-30, least(30, l_quantity - 25)))), 6) AS squashed FROM lineitem WINDOW p AS (PARTITION BY l_partkey)""")
def scaled_and_squashed(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    out = li.withColumn("scaled", arrays.min_max(F.col("l_quantity"), Window.partitionBy("l_partkey"))).withColumn("squashed", arrays.sigmoid(F.col("l_quantity") - 25))
    return rounded(out, "scaled", "squashed")


@query("""WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(3 + vec_id % 70 AS INT) AS n FROM embeddings)
SELECT vec_id, len(x) AS n, round(list_sum(x), 6) AS total, round(x[-1], 6) AS last FROM (SELECT vec_id, list_concat(v[1:n], list_transform(range(greatest(0, n - len(v))), lambda i: v[-1])) AS x FROM f)""")
def fitted_lengths(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = e.select("vec_id", arrays.fit_length(F.col("v"), (3 + F.col("vec_id") % 70).cast("int"), None).alias("x"))
    return x.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.element_at("x", -1), 6).alias("last"))


@query("""WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 5 + vec_id % 9 AS n FROM embeddings), g AS (SELECT vec_id, v, i, i * 63.0::DOUBLE / (n - 1) AS x FROM f, range(14) r(i) WHERE i < n)
SELECT vec_id, i, round(v[CAST(floor(x) AS INT) + 1] + (x - floor(x)) * (v[CAST(least(63, floor(x) + 1) AS INT) + 1] - v[CAST(floor(x) AS INT) + 1]), 6) AS y FROM g""")
def resampled_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = e.select("vec_id", F.posexplode(arrays.resampled("v", (5 + F.col("vec_id") % 9).cast("int"))).alias("i", "y"))
    return rounded(x.select("vec_id", F.col("i").cast("long").alias("i"), "y"), "y")


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey % 7), list(l_suppkey % 5)))), ' ') AS points FROM lineitem GROUP BY 1""")
def merged_points(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 7).alias("a"), F.collect_list(F.col("l_suppkey") % 5).alias("b"))
    return g.select("l_orderkey", F.array_join(arrays.sorted_unique(F.col("a"), F.col("b")), " ").alias("points"))


@query(f"{WITH}, l AS (SELECT rec, max(t) - min(t) AS length FROM ev GROUP BY rec) SELECT rec, round(coalesce(sum(length + 1) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS \"offset\" FROM l")
def recording_offsets(spark, d):
    g = timed(spark, d).groupBy("rec").agg((F.max("t") - F.min("t")).alias("length"))
    return rounded(windows.running_offset(g, "rec", "length").select("rec", "offset"), "offset", places=3)


TAPS = [2.718281828459045 ** (-0.5 * (k / 0.5) ** 2) for k in range(-2, 3)]
SMOOTH = " + ".join(f"{w / sum(TAPS)!r}::DOUBLE * " + ("value" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(value, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(value) OVER w)") for k, w in zip(range(-2, 3), TAPS, strict=True))


@query(f"{WITH} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS i, round({SMOOTH}, 6) AS y FROM ev WINDOW w AS (PARTITION BY rec ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def smoothed_series(spark, d):
    g = timed(spark, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("v"))
    out = g.select("rec", F.posexplode(windows.smoothed(0.5)("v")).alias("i", "y"))
    return rounded(out.select("rec", F.col("i").cast("long").alias("i"), "y"), "y")


# --- texts -----------------------------------------------------------------------------------

UNITS = r"(SELECT item_id, string_split(coalesce(text, ''), ' ') AS u FROM benchmark)"


def _units(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.split(F.coalesce("text", F.lit("")), " ").alias("u"))


@query(f"SELECT item_id, array_to_string(list_transform(range(1, len(u) + 1), lambda i: CAST(CAST(list_sum(list_transform(u[1:i], lambda x: len(x))) - len(u[i]) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(list_sum(list_transform(u[1:i], lambda x: len(x))) AS BIGINT) AS VARCHAR)), ' ') AS bounds FROM {UNITS}")
def syllable_spans(spark, d):
    return _units(spark, d).select("item_id", F.array_join(F.transform(text.span_bounds(F.col("u")), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ").alias("bounds"))


@query(f"SELECT item_id, array_to_string(u, '-') AS joined, 'ожидалось «' || u[1] || '», прозвучало «' || u[-1] || '»' AS hint FROM {UNITS}")
def joined_units_and_hints(spark, d):
    return _units(spark, d).select("item_id", text.joined_syllables(F.col("u")).alias("joined"), text.hint("substitution", F.get("u", F.lit(0)), F.element_at("u", -1)).alias("hint"))


@query("""WITH u AS (SELECT conv_id, turn, string_split(replace(coalesce(text, ''), 'k', '+'), ' ') AS u FROM conversations), m AS (SELECT conv_id, turn, list_filter(range(len(u)), lambda i: contains(u[i + 1], '+')) AS hits FROM u)
SELECT conv_id, turn, CASE WHEN len(hits) = 1 THEN CAST(hits[1] AS INT) END AS stressed FROM m""")
def manual_stress_marks(spark, d):
    u = F.split(F.translate(F.coalesce("text", F.lit("")), "k", "+"), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", text.manual_stress(u).alias("stressed"))


# --- recordings that tables share, windows of a stream read as a table -----------------------


def _recordings(spark, d):
    """Customers, and the customers that orders and events know."""
    own = lambda t, c: table(spark, d, t).select(F.col(c).cast("long").alias("recording_id"))
    return own("customer", "c_custkey"), own("orders", "o_custkey"), own("events", "user_id")


@query("SELECT c_custkey AS recording_id FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def recordings_in_all_tables(spark, d):
    return files.common(*_recordings(spark, d))


@query("""SELECT c_custkey AS recording_id, 0 AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def recordings_missing(spark, d):
    return files.missing(*_recordings(spark, d))


@query("SELECT c_custkey AS recording_id, c_name, text FROM customer LEFT JOIN documents ON doc_id = c_custkey")
def recordings_with_text(spark, d):
    audio = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("recording_id"), "c_name")
    return files.pair(audio, table(spark, d, "documents").select(F.col("doc_id").alias("recording_id"), "text"))


def _stream(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("SELECT user_id AS rec, epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    w = streams.tumbling(_stream(spark, d), "rec", "ts", "value", "1 day", "1 day")
    return rounded(w.select("rec", F.unix_seconds("start").alias("start"), "n", "mean"), "mean")


@query("SELECT user_id AS rec, epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) // 1000000 - k * 86400 AS start, round(sqrt(avg(value * value)), 6) AS rms FROM events, range(3) r(k) GROUP BY ALL")
def hopping_windows(spark, d):
    w = streams.hopping(_stream(spark, d), "rec", "ts", "value", "3 days", "1 day", "1 day")
    return rounded(w.select("rec", F.unix_seconds("start").alias("start"), "rms"), "rms")


@query(f"""{WITH}, g AS (SELECT rec, t, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t) < 86400 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT rec, t, sum(new) OVER (PARTITION BY rec ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT rec, CAST(floor(min(t)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY rec, g""")
def session_windows(spark, d):
    w = streams.phrases(_stream(spark, d), "rec", "ts", "1 day", "1 day")
    return w.select("rec", F.unix_seconds("start").alias("start"), "n")


@query("SELECT p.event_id AS id, c.event_id AS idx FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND p.ts BETWEEN c.ts - INTERVAL 30 MINUTE AND c.ts + INTERVAL 150 MINUTE")
def stream_interval_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    p = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("rec"), "ts")
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("idx"), F.col("user_id").alias("rec"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    return streams.assign(p, c, "rec", "ts", "start", "end", "30 minutes").select("id", "idx")
