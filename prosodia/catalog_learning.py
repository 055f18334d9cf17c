"""Queries of matching, sweeps and leave-one-out fits, with the SQL that says the same."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from prosodia.catalog import EV, HOUR, SQL, query, rounded, table, timed
from prosodia.operators import events
from prosodia.plans import folds, learn

#: Runs of purchases (p) and views (r) that no pair within an hour crosses, and each run's best pairs (m: positions in p and r).
PAIRS = f"""WITH RECURSIVE ev AS ({EV}),
b AS (SELECT rec, id, t, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS side FROM ev WHERE event_type IN ('purchase', 'view')),
near AS (
  SELECT *, max(CASE WHEN side = 0 THEN t END) OVER back AS lp, max(CASE WHEN side = 1 THEN t END) OVER back AS lr,
         min(CASE WHEN side = 0 THEN t END) OVER ahead AS np, min(CASE WHEN side = 1 THEN t END) OVER ahead AS nr
  FROM b WINDOW back AS (PARTITION BY rec ORDER BY t, side, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                ahead AS (PARTITION BY rec ORDER BY t, side, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), c AS (
  SELECT *, sum(CASE WHEN coalesce(nr - lp > 3600, true) AND coalesce(np - lr > 3600, true) THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t, side, id) AS run FROM near
), x AS (
  SELECT rec, run, list({{'t': t, 'id': id}} ORDER BY t, id) FILTER (side = 0) AS p, list({{'t': t, 'id': id}} ORDER BY t, id) FILTER (side = 1) AS r
  FROM c GROUP BY rec, run HAVING count(*) FILTER (side = 0) > 0 AND count(*) FILTER (side = 1) > 0
), k AS (
  SELECT rec, run, 1 AS i, 1 AS j, list_transform(range(len(r) + 1), lambda z: {{'n': 0, 'e': 0.0::DOUBLE, 'm': []::INTEGER[][]}}) AS above, [{{'n': 0, 'e': 0.0::DOUBLE, 'm': []::INTEGER[][]}}] AS cur FROM x
  UNION ALL
  SELECT rec, run, CASE WHEN j = m THEN i + 1 ELSE i END, CASE WHEN j = m THEN 1 ELSE j + 1 END,
         CASE WHEN j = m THEN list_append(cur, best) ELSE above END, CASE WHEN j = m THEN [{{'n': 0, 'e': 0.0::DOUBLE, 'm': []::INTEGER[][]}}] ELSE list_append(cur, best) END
  FROM (
    SELECT *, CASE WHEN gap <= 3600 AND (pair.n > skip.n OR (pair.n = skip.n AND pair.e < skip.e - 1e-12)) THEN pair ELSE skip END AS best
    FROM (
      SELECT k.*, len(x.r) AS m, abs(x.p[i].t - x.r[j].t) AS gap,
             CASE WHEN cur[j].n > above[j + 1].n OR (cur[j].n = above[j + 1].n AND cur[j].e < above[j + 1].e - 1e-12) THEN cur[j] ELSE above[j + 1] END AS skip,
             {{'n': above[j].n + 1, 'e': above[j].e + abs(x.p[i].t - x.r[j].t), 'm': list_append(above[j].m, [i, j])}} AS pair
      FROM k JOIN x ON k.rec = x.rec AND k.run = x.run WHERE i <= len(x.p)
    )
  )
), f AS (
  SELECT x.rec, x.p, x.r, unnest(k.above[len(x.r) + 1].m) AS m FROM k JOIN x ON k.rec = x.rec AND k.run = x.run WHERE k.i = len(x.p) + 1 AND k.j = 1
)"""

SQL["event_match"] = f"""{PAIRS}, n AS (SELECT rec, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nr FROM b GROUP BY rec),
q AS (SELECT rec, count(*) AS tp, median(abs(p[m[1]].t - r[m[2]].t)) AS gap FROM f GROUP BY rec),
o AS (SELECT n.rec, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, nr - coalesce(tp, 0) AS fn, gap FROM n LEFT JOIN q ON q.rec = n.rec)
SELECT rec, tp, fp, fn, round(gap, 6) AS timing_median, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM o"""


@query(f"""{PAIRS}, hit AS (SELECT p[m[1]].id AS id FROM f)
SELECT rec, id, CASE WHEN id IN (SELECT id FROM hit) THEN 1 ELSE 0 END AS label FROM b WHERE side = 0""")
def event_labels(spark, d):
    """Purchases that the matching pairs with a view within an hour."""
    return events.match_labels(timed(spark, d, "purchase"), timed(spark, d, "view"), "rec", "id", "t", HOUR).select("rec", "id", "label")


THRESHOLDS, DISTANCES = [20.0, 50.0, 80.0], [HOUR, 6 * HOUR]


@query(f"""WITH RECURSIVE ev AS ({EV}), s AS (
  SELECT rec, d, t, value, row_number() OVER (PARTITION BY rec, d ORDER BY value DESC, id) AS i FROM ev, (VALUES (3600), (21600)) g(d) WHERE event_type = 'view'
), k AS (
  SELECT rec, d, 0::BIGINT AS i, []::DOUBLE[] AS ts, []::DOUBLE[] AS vs FROM (SELECT DISTINCT rec, d FROM s)
  UNION ALL
  SELECT k.rec, k.d, s.i, CASE WHEN ok THEN list_append(k.ts, s.t) ELSE k.ts END, CASE WHEN ok THEN list_append(k.vs, s.value) ELSE k.vs END
  FROM k JOIN s ON s.rec = k.rec AND s.d = k.d AND s.i = k.i + 1, LATERAL (SELECT len(list_filter(k.ts, lambda x: abs(x - s.t) < s.d)) = 0 AS ok)
), kept AS (
  SELECT rec, d, unnest(ts) AS t, unnest(vs) AS v FROM k WHERE i = (SELECT max(i) FROM s WHERE s.rec = k.rec AND s.d = k.d)
), recs AS (
  SELECT DISTINCT rec FROM ev WHERE event_type IN ('view', 'purchase')
), x AS (
  SELECT recs.rec, d, th, coalesce((SELECT list(t ORDER BY t) FROM kept WHERE kept.rec = recs.rec AND kept.d = g.d AND v >= th), []) AS p,
         coalesce((SELECT list(t ORDER BY t) FROM ev WHERE ev.rec = recs.rec AND event_type = 'purchase'), []) AS r
  FROM recs, (VALUES (3600), (21600)) g(d), (VALUES (20.0), (50.0), (80.0)) h(th)
), w AS (
  SELECT rec, d, th, 1 AS i, 1 AS j, 0 AS n FROM x
  UNION ALL
  SELECT w.rec, w.d, w.th, i + CASE WHEN p[i] <= r[j] + 3600 THEN 1 ELSE 0 END, j + CASE WHEN p[i] >= r[j] - 3600 THEN 1 ELSE 0 END, n + CASE WHEN abs(p[i] - r[j]) <= 3600 THEN 1 ELSE 0 END
  FROM w JOIN x ON w.rec = x.rec AND w.d = x.d AND w.th = x.th WHERE i <= len(p) AND j <= len(r)
), c AS (
  SELECT x.rec, x.d, x.th, max(n) AS tp, len(any_value(p)) - max(n) AS fp, len(any_value(r)) - max(n) AS fn FROM w JOIN x ON w.rec = x.rec AND w.d = x.d AND w.th = x.th GROUP BY ALL
)
SELECT rec, CAST(th AS DOUBLE) AS threshold, CAST(d AS DOUBLE) AS distance, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM c""")
def threshold_sweep(spark, d):
    """Every threshold and distance per user from one pass over the views by falling value."""
    scored = timed(spark, d, "view").select(F.col("rec").alias("recording_id"), F.col("id").alias("event_id"), "t", F.col("value").alias("score"))
    truth = timed(spark, d, "purchase").select(F.col("rec").alias("recording_id"), "t")
    return learn.sweep(scored, truth, THRESHOLDS, DISTANCES, HOUR).select(F.col("recording_id").alias("rec"), "threshold", "distance", "tp", "fp", "fn")


@query("""
WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS x, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
g AS (SELECT DISTINCT g FROM o), fold AS (SELECT g AS a, g AS b FROM g UNION ALL SELECT p.g, q.g FROM g p JOIN g q ON p.g < q.g),
s AS (SELECT a, b, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n, sum(y) AS n1 FROM fold JOIN o ON o.g <> a AND o.g <> b GROUP BY a, b),
t AS (SELECT s.a, s.b, any_value(mu) AS mu, any_value(sd) AS sd, sum(w * z * z) / count(*) + 0.01 AS zz, sum(w * z) / count(*) AS zo, sum(w * (2 * y - 1) * z) / count(*) AS zy
  FROM (SELECT s.a, s.b, mu, sd, y, (x - mu) / sd AS z, CASE WHEN y = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END AS w FROM s JOIN o ON o.g <> s.a AND o.g <> s.b) s GROUP BY s.a, s.b)
SELECT a AS first_out, b AS second_out, round(zy / (zz - zo * zo) / sd * 1e6, 6) AS slope, round(-zo * zy / (zz - zo * zo) - zy / (zz - zo * zo) / sd * mu, 6) AS constant FROM t
""")
def leave_out_fits(spark, d):
    """Balanced ridge fits without one and without two order priorities, from one pass of sums."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("recording_id"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    fits = folds.fit(VectorAssembler(inputCols=["o_totalprice"], outputCol="features").transform(o), "least_squares")
    name = lambda i: fits.names[i]
    rows = [(name(f[0]), name(f[-1]), float(c[0]) * 1e6, float(c[1])) for f, c in zip(fits.left_out, fits.coefficients, strict=True)]
    return rounded(spark.createDataFrame(rows, "first_out string, second_out string, slope double, constant double"), "slope", "constant")
