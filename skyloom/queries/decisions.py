"""Queries of calibration and decisions: labelled documents and embeddings stand for scored sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import scores
from skyloom.operators import calibration, decide, resample
from skyloom.queries.registry import query, r6, table

#: A fixed logistic of the document's length stands for a model's score.
_P = "1 / (1 + exp(-(n_chars - 1500) / 2000.0))"
_SCORED = f"SELECT doc_id, quality AS y, p, greatest(p, 1 - p) AS conf, CASE WHEN (CASE WHEN p > 1 - p THEN 1 ELSE 0 END) = quality THEN 1.0 ELSE 0.0 END AS ok FROM (SELECT doc_id, quality, {_P} AS p FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 2000.0))
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), p.alias("p")).withColumn("probs", F.array(1 - F.col("p"), F.col("p")))


@query("ece", f"""
WITH s AS ({_SCORED}), b AS (SELECT ceil(conf * 10) AS bin, count(*) AS n, avg(conf) AS s, avg(ok) AS y FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(ok) FROM s), 6) AS accuracy, round((SELECT avg(2 * pow(p - y, 2)) FROM s), 6) AS brier, round(sum(n * abs(s - y)) / (SELECT count(*) FROM s), 6) AS ece, round(max(abs(s - y)), 6) AS mce FROM b
""")
def ece(spark, sf):
    e = calibration.calibration_errors(_scored(spark, sf), "probs", "y")
    return e.select("n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "brier", "ece", "mce")])


_DEBIASED = f"""
WITH s AS ({_SCORED}), b AS (SELECT BIN AS bin, count(*) AS n, avg(conf) AS s, avg(ok) AS y FROM s GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * pow(s - y, 2)) / sum(n) AS a, sum(n * (pow(s - y, 2) - CASE WHEN n > 1 THEN y * (1 - y) / (n - 1) ELSE 0 END)) / sum(n) AS b FROM b)
SELECT n::BIGINT AS n, round(a, 6) AS squared_plugin, round(LOW, 6) AS squared_debiased, round(sqrt(a), 6) AS root_plugin, round(sqrt(greatest(b, 0)), 6) AS root_debiased FROM t
"""


@query("debiased_ece", _DEBIASED.replace("BIN", "ceil(conf * 15)").replace("LOW", "b"))
def debiased_ece(spark, sf):
    e = calibration.debiased_error(_scored(spark, sf), "probs", "y")
    return e.select("n", *[r6(F.col(c)).alias(c) for c in ("squared_plugin", "squared_debiased", "root_plugin", "root_debiased")])


@query("debiased_ece_from", _DEBIASED.replace("BIN", "least(floor(conf * 15), 14)").replace("LOW", "greatest(b, 0)"))
def debiased_ece_from(spark, sf):
    e = calibration.debiased_error(_scored(spark, sf), "probs", "y", mode="from")
    return e.select("n", *[r6(F.col(c)).alias(c) for c in ("squared_plugin", "squared_debiased", "root_plugin", "root_debiased")])


@query("proper_scores", f"""
SELECT doc_id, round(1 - pow(p - y, 2), 6) AS brier, round(1 + ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-7)) / ln(2), 6) AS log_score,
 round(CASE WHEN ok = 1 THEN ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 0.01), 0.99)) ELSE ln(1 - least(greatest(conf, 0.01), 0.99)) END, 6) AS doubt FROM ({_SCORED})
""")
def proper_scores(spark, sf):
    p, y = F.col("probs"), F.col("y")
    return _scored(spark, sf).select("doc_id", r6(scores.brier(p, y)).alias("brier"), r6(scores.log_score(p, y)).alias("log_score"), r6(scores.doubt_score(p, y)).alias("doubt"))


@query("skill_scores", f"""
WITH c AS (SELECT count(*) FILTER (p > 0.6 AND y = 1) AS tp, count(*) FILTER (p > 0.6 AND y = 0) AS fp, count(*) FILTER (p <= 0.6 AND y = 1) AS fn, count(*) FILTER (p <= 0.6 AND y = 0) AS tn FROM ({_SCORED}))
SELECT tp, fp, fn, tn, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS tpr, round(fp / greatest(fp + tn, 1)::DOUBLE, 6) AS fpr, round(tp / greatest(tp + fn, 1)::DOUBLE - fp / greatest(fp + tn, 1)::DOUBLE, 6) AS tss,
 round(2 * (tp * tn - fp * fn)::DOUBLE / greatest((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 1), 6) AS hss FROM c
""")
def skill_scores(spark, sf):
    s = calibration.skill(_scored(spark, sf), F.col("p") > 0.6, F.col("y") == 1)
    return s.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("tpr", "fpr", "tss", "hss")])


@query("wilson", """
SELECT source, k, n, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low,
 round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high
FROM (SELECT source, sum(quality)::BIGINT AS k, count(*) AS n, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1)
""")
def wilson(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    g = d.groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = scores.wilson(F.col("k"), F.col("n"))
    return g.select("source", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


_SCAN = f"""
WITH s AS ({_SCORED}), l AS (SELECT DISTINCT p AS lam FROM s UNION SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE])), n AS (SELECT count(*) AS n, sum(y) AS t FROM s),
c AS (SELECT lam, count(p) AS k, count(p) FILTER (y = 1) AS h FROM l LEFT JOIN s ON s.p >= l.lam GROUP BY lam),
r AS (SELECT *, CASE WHEN k > 0 THEN (k - h) / k::DOUBLE ELSE 0 END AS risk FROM c, n), o AS (SELECT *, n / (n + 1.0) * risk + 1 / (n + 1.0) <= 0.15 AS ok FROM r)
"""


@query("crc_strict", _SCAN + """SELECT n, round(coalesce(min(lam) FILTER (ok), 1), 6) AS threshold, round(coalesce(arg_min(risk, lam) FILTER (ok), 0), 6) AS risk,
 round(coalesce(arg_min(k / n::DOUBLE, lam) FILTER (ok), 0), 6) AS retention, coalesce(arg_min(k, lam) FILTER (ok), 0) > 0 AS feasible FROM o GROUP BY n""")
def crc_strict(spark, sf):
    c = calibration.risk_control(_scored(spark, sf), "p", F.col("y") == 1, 0.15, "strict")
    return c.select("n", *[r6(F.col(x)).alias(x) for x in ("threshold", "risk", "retention")], "feasible")


@query("crc_targets", _SCAN + """SELECT n, round(coalesce(min(lam) FILTER (ok AND k > 0), 0.85), 6) AS threshold, round(coalesce(arg_min(risk, lam) FILTER (ok AND k > 0), arg_min(risk, lam) FILTER (lam >= 0.85), 0), 6) AS risk,
 round(coalesce(arg_min(h / greatest(t, 1)::DOUBLE, lam) FILTER (ok AND k > 0), arg_min(h / greatest(t, 1)::DOUBLE, lam) FILTER (lam >= 0.85), 0), 6) AS retention, count(*) FILTER (ok AND k > 0) > 0 AS feasible FROM o GROUP BY n""")
def crc_targets(spark, sf):
    c = calibration.risk_control(_scored(spark, sf), "p", F.col("y") == 1, 0.15, "targets")
    return c.select("n", *[r6(F.col(x)).alias(x) for x in ("threshold", "risk", "retention")], "feasible")


@query("crc_passing", _SCAN.replace("0.15", "0.05") + """SELECT n, round(coalesce(min(lam) FILTER (ok AND k > 0), 0.85), 6) AS threshold, round(coalesce(arg_min(risk, lam) FILTER (ok AND k > 0), 0), 6) AS risk,
 round(coalesce(arg_min(h / greatest(t, 1)::DOUBLE, lam) FILTER (ok AND k > 0), 0), 6) AS retention, count(*) FILTER (ok AND k > 0) > 0 AS feasible FROM o GROUP BY n""")
def crc_passing(spark, sf):
    c = calibration.risk_control(_scored(spark, sf), "p", F.col("y") == 1, 0.05, "passing")
    return c.select("n", *[r6(F.col(x)).alias(x) for x in ("threshold", "risk", "retention")], "feasible")


def _temperature_sql(passes: int) -> str:
    """Newton's steps for one over the temperature of two logits [0, z], written out."""
    ctes = ["b0 AS (SELECT 1.0::DOUBLE AS b)"]
    for k in range(passes):
        p = "(1 / (1 + exp(-b * z)))"
        ctes.append(f"b{k + 1} AS (SELECT any_value(b) - sum({p} * z - y * z) / sum({p} * (1 - {p}) * z * z) AS b FROM l, b{k})")
    return ", ".join(ctes)


@query("scaling_binning", f"""
WITH l AS (SELECT doc_id, quality AS y, (n_chars - 1500) / 2000.0::DOUBLE AS z FROM labels JOIN documents USING (doc_id)), {_temperature_sql(25)},
c AS (SELECT doc_id, y, greatest(p, 1 - p) AS conf, p FROM (SELECT doc_id, y, 1 / (1 + exp(-b * z)) AS p FROM l, b25)), e AS (SELECT quantile_cont(conf, [0.2, 0.4, 0.6, 0.8]) AS e FROM c),
d AS (SELECT c.*, len(list_filter(e, lambda x: conf >= x)) AS bin, CASE WHEN (p > 1 - p)::INTEGER = y THEN 1.0 ELSE 0.0 END AS ok FROM c, e), v AS (SELECT bin, avg(ok) AS v, count(*) AS n FROM d GROUP BY bin)
SELECT doc_id, round(1 / b, 5) AS temperature, bin, round(v, 6) AS confidence, round(CASE WHEN p > 1 - p THEN v WHEN conf < 1 THEN p * (1 - v) / (1 - conf + 1e-12) ELSE p END, 6) AS p_good FROM d JOIN v USING (bin), b25
""")
def scaling_binning(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select("doc_id", F.col("quality").alias("y"), F.array(F.lit(0.0), (F.col("n_chars") - 1500) / 2000.0).alias("logits"))
    m = calibration.fit_scaling_binning(d, "logits", "y", 5)
    found = calibration.apply_scaling_binning(d, m, "logits")
    which = F.size(F.filter(F.array(*[F.lit(e) for e in m.edges[1:-1]]), lambda e: F.array_max(calibration._softmax(F.col("logits"), m.temperature)) >= e))
    return found.select("doc_id", F.round(F.lit(m.temperature), 5).alias("temperature"), which.cast("long").alias("bin"), r6(F.col("confidence")).alias("confidence"), r6(F.col("probs")[1]).alias("p_good"))


@query("conformal_threshold", f"""
WITH s AS (SELECT 1 - CASE WHEN y = 1 THEN p ELSE 1 - p END AS score FROM ({_SCORED})), r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT n, round(min(score), 6) AS threshold FROM r WHERE i = ceil(ceil((n + 1) * (1 - 0.1)) / n * (n - 1)) GROUP BY n
""")
def conformal_threshold(spark, sf):
    c = calibration.conformal_threshold(_scored(spark, sf), "probs", "y", alpha=0.1)
    return c.select("n", r6(F.col("threshold")).alias("threshold"))


_ALPHA = "[1 + ln(1 + exp(embedding[1]::DOUBLE * 4)), 1 + ln(1 + exp(embedding[2]::DOUBLE * 4)), 1 + ln(1 + exp(embedding[3]::DOUBLE * 4)), 1 + ln(1 + exp(embedding[4]::DOUBLE * 4))]"
NAMES = ["Quasar_AGN", "Star", "Galaxy", "Transient"]


def _evidence(spark, sf):
    alpha = F.transform(F.slice("embedding", 1, 4), lambda x: 1 + F.log1p(F.exp(x.cast("double") * 4)))
    return decide.with_dirichlet(table(spark, sf, "embeddings").select("vec_id", alpha.alias("alpha")), "alpha", NAMES)


@query("dirichlet_stats", f"""
WITH e AS (SELECT vec_id, {_ALPHA} AS a, list_sum({_ALPHA}) AS s FROM embeddings), q AS (SELECT *, list_max(a) / s AS p FROM e)
SELECT vec_id, (list_position(a, list_max(a)) - 1)::INT AS top, round(p, 6) AS confidence, round(sqrt(p * (1 - p) / (s + 1)), 6) AS error, round(4 / s, 6) AS vacuity FROM q
""")
def dirichlet_stats(spark, sf):
    return _evidence(spark, sf).select("vec_id", "top", *[r6(F.col(c)).alias(c) for c in ("confidence", "error", "vacuity")])


@query("bald", f"""
WITH e AS (SELECT vec_id, unnest({_ALPHA}) AS a, list_sum({_ALPHA}) AS s FROM embeddings),
g AS (SELECT *, (lgamma(a + 1 + 1e-5) - lgamma(a + 1 - 1e-5)) / 2e-5 AS da, (lgamma(s + 1 + 1e-5) - lgamma(s + 1 - 1e-5)) / 2e-5 AS ds FROM e)
SELECT vec_id, round(greatest(0, sum(-a / s * ln(a / s)) + sum(a / s * (da - ds))), 4) AS gain FROM g GROUP BY 1
""")
def bald(spark, sf):
    return _evidence(spark, sf).select("vec_id", r6(F.col("gain"), 4).alias("gain"))


def _tension(spark, sf):
    return _evidence(spark, sf).withColumn("tension", (F.col("vec_id") % 20) / 100.0)


#: The evidence and the four-way gate, written out from the definitions of the summaries.
_GATE = f"""
WITH e AS (SELECT vec_id, {_ALPHA} AS a, list_sum({_ALPHA}) AS s, (vec_id % 20) / 100.0::DOUBLE AS tension FROM embeddings),
g AS (SELECT vec_id, unnest(a) AS x, s FROM e),
i AS (SELECT vec_id, greatest(0, sum(-x / s * ln(x / s)) + sum(x / s * ((lgamma(x + 1 + 1e-5) - lgamma(x + 1 - 1e-5)) / 2e-5 - (lgamma(s + 1 + 1e-5) - lgamma(s + 1 - 1e-5)) / 2e-5))) AS gain FROM g GROUP BY 1),
q AS (SELECT e.vec_id, gain, tension, list_position(a, list_max(a)) - 1 AS top, list_max(a) / s AS p, 4 / s AS vacuity, sqrt(list_max(a) / s * (1 - list_max(a) / s) / (s + 1)) AS error FROM e JOIN i USING (vec_id)),
d AS (SELECT vec_id, CASE WHEN gain >= 0.35 OR (top = 0 AND (vacuity >= 0.35 OR error >= 0.12)) THEN 'URGENT_FOLLOWUP'
 WHEN p >= 0.80 AND vacuity <= 0.25 AND tension <= 0.12 AND least(1, greatest(0, p - 1.96 * error)) >= 0.50 THEN 'AUTO_CATALOG'
 WHEN tension >= 0.15 THEN 'EXTEND_DELIBERATION' ELSE 'PASS_DEFER' END AS action FROM q)
"""


@query("gate_stream", _GATE + "SELECT vec_id, action FROM d")
def gate_stream(spark, sf):
    return _tension(spark, sf).select("vec_id", decide.alert_action().alias("action"))


@query("gate_counts", _GATE + "SELECT action, count(*) AS n FROM d GROUP BY 1")
def gate_counts(spark, sf):
    return _tension(spark, sf).groupBy(decide.alert_action().alias("action")).agg(F.count(F.lit(1)).alias("n"))


def _sources(spark, sf):
    e, v = table(spark, sf, "events"), F.col("value")
    cls = F.when(F.col("event_type") == "view", "Quasar_AGN").otherwise("Star")
    return e.select("event_id", cls.alias("class"), (0.5 + v / 200).alias("confidence"), (v / 100).alias("purity"), (0.6 - v / 200).alias("vacuity"), ((F.col("event_id") % 20) / 100.0).alias("tension"), (18 + F.col("event_id") % 5).cast("double").alias("phot_g"), ((F.col("event_id") % 13) / 10.0).alias("w1_w2"), (F.col("event_id") % 6).cast("double").alias("pm"), ((F.col("event_id") % 4) / 1.0).alias("pm_err"))


@query("gate_followup", """
WITH s AS (SELECT event_id, event_type = 'view' AND 0.5 + value / 200 >= 0.85 AND value / 100 >= 0.5 AND 0.6 - value / 200 <= 0.20 AS auto, 0.6 - value / 200 AS vac, (event_id % 20) / 100.0 AS ten,
 CASE WHEN (event_id % 13) / 10.0 < 0.8 AND 18 + event_id % 5 <= 21 THEN 'MAST' WHEN event_id % 4 >= 1.5 AND event_id % 6 < 3 THEN 'GAIA_EPOCH' ELSE 'HEASARC' END AS arc FROM events)
SELECT event_id, 'AUTO_CATALOG' AS action, NULL AS archive FROM s WHERE auto UNION ALL SELECT event_id, 'CONTRACTIVE_DELIBERATION', NULL FROM s WHERE NOT auto AND ten >= 0.12
UNION ALL SELECT event_id, 'SCHEDULE_FOLLOWUP_QUERY', arc FROM s WHERE NOT auto AND vac >= 0.35
""")
def gate_followup(spark, sf):
    return decide.route_sources(_sources(spark, sf)).select("event_id", "action", "archive")


@query("gate_weather", """
SELECT event_id, CASE WHEN value / 100 >= 0.85 AND (event_id % 50) / 100.0 <= 0.30 AND value / 100 - 1.96 * 0.1 >= 0.40 THEN 'TRIGGER_GLOBAL_SPACE_WEATHER_ALERT' WHEN (event_id % 10) / 100.0 > 0.05 AND event_id % 8 < 4 THEN 'DISPATCH_PLANETARY_DEFENSE_RADAR'
 WHEN ((event_id % 10) / 100.0 > 0.01 AND event_id % 8 >= 4) OR (event_id % 50) / 100.0 > 0.40 THEN 'QUEUE_ROBOTIC_TRACKING' ELSE 'PASS_NOMINAL' END AS action FROM events
""")
def gate_weather(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("p_storm"), F.lit(0.1).alias("error"), ((k % 50) / 100.0).alias("vacuity"), ((k % 10) / 100.0).alias("p_impact"), (k % 8).cast("double").alias("arc_hours"))
    return e.select("event_id", decide.weather_action().alias("action"))


@query("validate_packets", """
SELECT event_id, (CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 400 > 360 THEN 1 ELSE 0 END) + (CASE WHEN value / 2 <= 0 OR value / 2 >= 35 THEN 1 ELSE 0 END) AS errors FROM events
""")
def validate_packets(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.when(k % 9 != 0, k.cast("string")).alias("alert_id"), (k % 400).cast("double").alias("ra"), F.lit(10.0).alias("dec"), (F.col("value") / 2).alias("mag"), F.lit(0.1).alias("mag_err"), F.lit("r").alias("filter_band"))
    return e.select("event_id", F.size(decide.packet_errors()).alias("errors"))


#: Each feature from its definition, imputed where a band is missing.
_PACKETS = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 15 + value / 20 END AS g0, CASE WHEN event_id % 7 <> 0 THEN 15.2 + value / 20 END AS bp, CASE WHEN event_id % 11 <> 0 THEN 14.7 + value / 20 END AS rp,
  CASE WHEN event_id % 3 <> 0 THEN 12 + value / 20 END AS w1v, CASE WHEN event_id % 4 <> 0 THEN 11 + value / 20 END AS w2v, CASE WHEN event_id % 6 <> 0 THEN value / 50 END AS pm, event_id % 360 AS l, event_id % 180 - 90 AS b FROM events),
h AS (SELECT *, coalesce(g0 > 5 AND g0 < 25, false) AS has_g, coalesce(w1v > 5 AND w1v < 25, false) AS has_1, coalesce(w2v > 5 AND w2v < 25, false) AS has_2, bp IS NOT NULL AND rp IS NOT NULL AS has_c, pm IS NOT NULL AS has_pm FROM e),
g AS (SELECT *, CASE WHEN has_g THEN g0 ELSE 20.0 END AS g FROM h),
w AS (SELECT *, CASE WHEN has_1 THEN w1v ELSE g - 2.8 END AS w1 FROM g)
SELECT event_id, k::INTEGER AS k, round(CASE k WHEN 0 THEN g WHEN 1 THEN CASE WHEN has_c THEN bp - rp ELSE 0.6 END WHEN 2 THEN coalesce(g - bp, -0.3) WHEN 3 THEN w1 WHEN 4 THEN CASE WHEN has_1 AND has_2 THEN w1 - w2v ELSE 0.95 END
  WHEN 5 THEN coalesce(pm, 0.2) WHEN 6 THEN CASE WHEN has_pm THEN sqrt(0.1 * 0.1 + 0.2 * 0.2) ELSE 0.2 END WHEN 7 THEN l / 360.0 WHEN 8 THEN (b + 90) / 180.0 ELSE least(100.0, greatest(5.0, 100.0 / greatest(g - 14.0, 1.0))) END, 6) AS mu,
  CASE k WHEN 0 THEN has_g WHEN 1 THEN has_c WHEN 2 THEN has_1 WHEN 3 THEN has_1 AND has_2 WHEN 4 THEN has_pm WHEN 5 THEN true ELSE false END AS valid
FROM w, (SELECT unnest(range(10)) AS k)
"""


@query("feature_packets", _PACKETS)
def feature_packets(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    hole = lambda n, x: F.when(k % n == 0, float("nan")).otherwise(x)
    e = table(spark, sf, "events").select("event_id", hole(5, 15 + v / 20).alias("phot_g_mean_mag"), hole(7, 15.2 + v / 20).alias("phot_bp_mean_mag"), hole(11, 14.7 + v / 20).alias("phot_rp_mean_mag"), hole(3, 12 + v / 20).alias("mag_w1_vg"), hole(4, 11 + v / 20).alias("mag_w2_vg"), hole(6, v / 50).alias("pm"), F.lit(0.1).alias("pmra_error"), F.lit(0.2).alias("pmdec_error"), (k % 360).cast("double").alias("l"), (k % 180 - 90).cast("double").alias("b"))
    p = decide.feature_packet(e).select("event_id", F.posexplode("mu").alias("k", "mu"), "mask")
    return p.select("event_id", "k", r6(F.col("mu")).alias("mu"), F.coalesce(F.get("mask", F.col("k")) == 1, F.lit(False)).alias("valid"))


_DRAWS = 40
_DRAWN = f"d AS (SELECT unnest(range(0, {_DRAWS + 1})) AS draw)"
_SCORES = "SELECT user_id, event_type IN ('view', 'click') AS control, value AS d0, value * 0.7 + (event_id * 37) % 101 * 0.4 AS d1 FROM events"


@query("cluster_bootstrap", f"""
WITH {_DRAWN}, s AS ({_SCORES}), u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT draw, user_id, {resample.sql_weight(3, "draw", "user_id")} AS m FROM u, d),
c AS (SELECT draw, d0, d1, m FROM s JOIN m USING (user_id) WHERE control), n AS (SELECT draw, sum(m) AS n FROM c GROUP BY draw HAVING sum(m) > 0),
a AS (SELECT draw, d0 AS x, sum(sum(m)) OVER (PARTITION BY draw ORDER BY d0) AS upto FROM c GROUP BY draw, d0), b AS (SELECT draw, d1 AS x, sum(sum(m)) OVER (PARTITION BY draw ORDER BY d1) AS upto FROM c GROUP BY draw, d1),
ta AS (SELECT draw, min(x) AS t FROM a JOIN n USING (draw) WHERE upto > ceil(0.95::DOUBLE * (n - 1)) GROUP BY draw), tb AS (SELECT draw, min(x) AS t FROM b JOIN n USING (draw) WHERE upto > ceil(0.95::DOUBLE * (n - 1)) GROUP BY draw),
r AS (SELECT draw, sum(m) AS n, sum(m) FILTER (d0 > ta.t) / sum(m) AS a, sum(m) FILTER (d1 > tb.t) / sum(m) AS b FROM s JOIN m USING (user_id) JOIN ta USING (draw) JOIN tb USING (draw) WHERE NOT control GROUP BY draw HAVING sum(m) > 0),
z AS (SELECT draw, n, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM r)
SELECT max(n) FILTER (draw = 0)::BIGINT AS n, round(max(a) FILTER (draw = 0), 6) AS recall_first, round(max(b) FILTER (draw = 0), 6) AS recall_second, round(max(b - a) FILTER (draw = 0), 6) AS delta,
 round(quantile_cont(b - a, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(b - a, 0.975) FILTER (draw > 0), 6) AS high FROM z
""")
def cluster_bootstrap(spark, sf):
    e = table(spark, sf, "events")
    s = e.select("user_id", F.col("event_type").isin("view", "click").alias("control"), F.col("value").alias("d0"), (F.col("value") * 0.7 + F.col("event_id") * 37 % 101 * 0.4).alias("d1"))
    found = resample.recall_difference(s.where("control"), s.where("NOT control"), "d0", "d1", "user_id", 0.05, _DRAWS, 3)
    return found.select("n", *[r6(F.col(c)).alias(c) for c in ("recall_first", "recall_second", "delta", "low", "high")])


@query("calibration_interval", f"""
WITH {_DRAWN}, s AS ({_SCORED}), w AS (SELECT draw, ceil(conf * 15) AS bin, conf, ok, {resample.sql_weight(42, "draw", "doc_id")} AS m FROM s, d),
b AS (SELECT draw, bin, sum(m) AS n, abs(sum(m * conf) - sum(m * ok)) AS gap FROM w GROUP BY 1, 2), e AS (SELECT draw, sum(n) AS n, sum(gap) / sum(n) AS e FROM b GROUP BY 1)
SELECT max(n) FILTER (draw = 0)::BIGINT AS n, round(max(e) FILTER (draw = 0), 6) AS ece, round(quantile_cont(e, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(e, 0.975) FILTER (draw > 0), 6) AS high FROM e
""")
def calibration_interval(spark, sf):
    s = calibration.with_confidence(_scored(spark, sf), "probs", "y")
    found = resample.calibration_interval(s, "confidence", "correct", "doc_id", 15, _DRAWS)
    return found.select("n", *[r6(F.col(c)).alias(c) for c in ("ece", "low", "high")])
