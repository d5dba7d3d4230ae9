"""Queries of fitting, evaluation, quality checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions import pmf as X
from priorframe.functions.rates import safe_rate, shrink_rate, sigmoid
from priorframe.operators import asof, market as M, quality as Q, slates
from priorframe.plans import evaluate as E, fit
from priorframe.queries.positions import cap_sql
from priorframe.queries.base import BETS, EPISODES, LOG, bets, episodes, log, query, r
from priorframe.streaming import live

PREDS = LOG + """, pr AS (SELECT event_id, entity, day, epoch, kind, k, value, success AS y, 0.05 + (event_id * 37 % 900) / 1000.0::DOUBLE AS p, 0.1 + (event_id * 53 % 300) / 1000.0::DOUBLE AS b, CAST(k % 4 AS INTEGER) AS line FROM log)"""


def preds(spark, sf):
    e = log(spark, sf)
    return e.select("event_id", "entity", "day", "epoch", "kind", "k", "value", F.col("success").alias("y"), (0.05 + F.col("event_id") * 37 % 900 / 1000).alias("p"), (0.1 + F.col("event_id") * 53 % 300 / 1000).alias("b"), (F.col("k") % 4).alias("line"))


SCORES = "round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(p - y), 6) AS bias, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, count(*) AS n"


@query("brier_by_line", f"WITH {PREDS} SELECT CAST(line AS VARCHAR) AS line, {SCORES} FROM pr GROUP BY line UNION ALL SELECT 'all', {SCORES} FROM pr")
def brier(spark, sf):
    rows = preds(spark, sf)
    x = rows.groupBy(F.col("line").cast("string").alias("line")).agg(*E.scores("p", "y")).unionByName(rows.groupBy(F.lit("all").alias("line")).agg(*E.scores("p", "y")))
    return x.select("line", r("brier"), r("log_loss"), r("bias"), r("mae"), r("rmse"), "n")


CAL = f"{PREDS}, x AS (SELECT *, row_number() OVER (ORDER BY p, event_id) - 1 AS rk, count(*) OVER () AS nn FROM pr), c AS (SELECT CAST((SELECT count(*) FROM range(1, 10) t(i) WHERE floor(i * nn / 10) <= rk) AS INTEGER) AS bin, p, y FROM x), t AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS rate, sum(y) AS hits FROM c GROUP BY bin)"


@query("calibration_table", f"WITH {CAL}, w AS (SELECT *, hits / n::DOUBLE AS q, n::DOUBLE AS m FROM t) SELECT bin, n, round(p, 6) AS p, round(rate, 6) AS rate, round((q + 1.9208 / m - 1.96 * sqrt(q * (1 - q) / m + 0.9604 / (m * m))) / (1 + 3.8416 / m), 6) AS low, round((q + 1.9208 / m + 1.96 * sqrt(q * (1 - q) / m + 0.9604 / (m * m))) / (1 + 3.8416 / m), 6) AS high FROM w")
def calibration(spark, sf):
    return E.calibration_table(preds(spark, sf), "p", "y", ["event_id"]).select("bin", "n", r("p"), r("rate"), r("low"), r("high"))


@query("ece", f"WITH {CAL} SELECT round(sum(n * abs(p - rate)) / sum(n), 6) AS ece, round(sqrt(sum(n * (p - rate) * (p - rate)) / sum(n)), 6) AS rms FROM t")
def ece(spark, sf):
    t = E.calibration_table(preds(spark, sf), "p", "y", ["event_id"])
    return E.ece(t).crossJoin(E.ece(t, True).withColumnRenamed("ece", "rms")).select(r("ece"), r("rms"))


@query("paired_test", f"WITH {PREDS}, d AS (SELECT entity, (b - y) * (b - y) - (p - y) * (p - y) AS d FROM pr), c AS (SELECT avg(d) AS d FROM d GROUP BY entity) SELECT 'rows' AS unit, round(avg(d), 7) AS gain, round(stddev_samp(d) / sqrt(count(d)), 7) AS se, count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS z FROM d UNION ALL SELECT 'clusters', round(avg(d), 7), round(stddev_samp(d) / sqrt(count(d)), 7), count(d), round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) FROM c")
def paired(spark, sf):
    rows = preds(spark, sf)
    x = E.paired_test(rows, "p", "b", "y").withColumn("unit", F.lit("rows")).unionByName(E.paired_test(rows, "p", "b", "y", ["entity"]).withColumn("unit", F.lit("clusters")))
    return x.select("unit", r("gain", 7), r("se", 7), "n", r("z", 4))


@query("lattice_table", f"WITH {EPISODES}, q AS (SELECT entity, least(n, 8) AS k FROM ep), h AS (SELECT k, count(*) AS c FROM q GROUP BY k), t AS (SELECT count(*) AS n FROM q), s AS (SELECT unnest(range(0, 9)) AS k) SELECT CAST(s.k AS INTEGER) AS k, round(1 / 9.0::DOUBLE, 6) AS predicted, round(coalesce(c, 0) / n::DOUBLE, 6) AS observed, round((coalesce(c, 0) / n::DOUBLE - 1 / 9.0::DOUBLE) / sqrt(1 / 9.0::DOUBLE * (8 / 9.0::DOUBLE) / n), 4) AS z FROM s LEFT JOIN h USING (k), t")
def lattice(spark, sf):
    ep = episodes(spark, sf).select(F.least("n", F.lit(8)).cast("int").alias("k"), F.array_repeat(F.lit(1 / 9), 9).alias("pmf"))
    mean = ep.select(F.posexplode("pmf").alias("k", "p")).groupBy("k").agg(F.avg("p").alias("predicted"), F.count(F.lit(1)).alias("n"))
    x = mean.join(ep.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k", "left").withColumn("observed", F.coalesce("c", F.lit(0)) / F.col("n"))
    return x.select("k", r("predicted"), r("observed"), F.round((F.col("observed") - F.col("predicted")) / F.sqrt(F.col("predicted") * (1 - F.col("predicted")) / F.col("n")), 4).alias("z"))


@query("line_matched_baseline", f"WITH {PREDS}, bl AS (SELECT line, avg((b - y) * (b - y)) AS base FROM pr WHERE epoch <= 2 GROUP BY line), lv AS (SELECT * FROM pr WHERE epoch > 2 AND line < 3) SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(base), 6) AS matched, round(avg((p - y) * (p - y)) - avg(p * (1 - p)), 6) AS excess, CASE WHEN abs(avg((p - y) * (p - y)) - avg(base)) <= greatest(0.005, 2 * stddev_samp((p - y) * (p - y)) / sqrt(count(*))) THEN 'level' WHEN avg((p - y) * (p - y)) < avg(base) THEN 'better' ELSE 'worse' END AS verdict FROM lv LEFT JOIN bl USING (line)")
def line_matched(spark, sf):
    rows = preds(spark, sf)
    base = rows.filter("epoch <= 2").groupBy("line").agg(F.avg((F.col("b") - F.col("y")) * (F.col("b") - F.col("y"))).alias("base"))
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    x = rows.filter("epoch > 2 and line < 3").join(base, "line", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(sq).alias("brier"), F.avg("base").alias("matched"), F.avg(F.col("p") * (1 - F.col("p"))).alias("floor"), (F.stddev_samp(sq) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    gap = F.col("brier") - F.col("matched")
    return x.select("n", r("brier"), r("matched"), F.round(F.col("brier") - F.col("floor"), 6).alias("excess"), F.when(F.abs(gap) <= F.greatest(F.lit(0.005), 2 * F.col("se")), "level").when(gap < 0, "better").otherwise("worse").alias("verdict"))


@query("live_report", f"WITH {PREDS} SELECT day, round(avg(value - 50), 5) AS error, round(avg(CASE WHEN abs(value - 50) <= 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within, round(avg(CASE WHEN value - 50 <= -40 THEN 1.0::DOUBLE ELSE 0 END), 6) AS far_below, CASE WHEN count(*) FILTER (k > 30) >= 20 THEN 'live' ELSE 'all' END AS basis FROM pr GROUP BY day")
def live_report(spark, sf):
    d = F.col("value") - 50
    return preds(spark, sf).groupBy("day").agg(F.round(F.avg(d), 5).alias("error"), F.round(F.avg((F.abs(d) <= 30).cast("double")), 6).alias("within"), F.round(F.avg((d <= -40).cast("double")), 6).alias("far_below"), F.when(F.count_if(F.col("k") > 30) >= 20, "live").otherwise("all").alias("basis"))


@query("corr_matrix", f"WITH {PREDS} SELECT * FROM (SELECT 'k' AS a, 'value' AS b, round(corr(k, value), 6) AS r FROM pr UNION ALL SELECT 'k', 'p', round(corr(k, p), 6) FROM pr UNION ALL SELECT 'value', 'p', round(corr(value, p), 6) FROM pr)")
def corr(spark, sf):
    return E.correlations(preds(spark, sf), ["k", "value", "p"]).select("a", "b", r("r"))


@query("promotion_blockers", f"WITH {PREDS}, g AS (SELECT kind, count(*) AS n, avg((b - y) * (b - y) - (p - y) * (p - y)) / (stddev_samp((b - y) * (b - y) - (p - y) * (p - y)) / sqrt(count(*))) AS z FROM pr GROUP BY kind) SELECT kind, (n >= 100 AND z >= 2) AS ready, CAST((n < 100)::INT + (z < 2)::INT + (z < 0)::INT AS INTEGER) AS blockers FROM g")
def blockers(spark, sf):
    d = (F.col("b") - F.col("y")) * (F.col("b") - F.col("y")) - (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    g = preds(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))))).alias("z"))
    return E.promotion_blockers(g, "n", "z").select("kind", "ready", F.size("blockers").alias("blockers"))


@query("ols_fit", f"WITH {PREDS} SELECT round(regr_slope(value, k), 7) AS slope, round(regr_intercept(value, k), 6) AS intercept FROM pr")
def ols(spark, sf):
    f = fit.ols(preds(spark, sf), ["k"], "value")
    return spark.createDataFrame([(round(float(f.coef[1]), 7), round(float(f.coef[0]), 6))], "slope double, intercept double")


@query("residual_feature", f"WITH {PREDS}, f AS (SELECT regr_slope(value, k) AS s, regr_intercept(value, k) AS i FROM pr) SELECT event_id, round(value - i - s * k, 5) AS residual FROM pr, f")
def residual(spark, sf):
    return E.residual_feature(preds(spark, sf), "value", ["k"], "residual").select("event_id", r("residual", 5))


@query("logit_fit")
def logit(spark, sf):
    rows = preds(spark, sf).withColumn("z", F.col("value") / 100).withColumn("d", F.col("k") / 100)
    return fit.logistic(rows, ["z", "d"], "y", penalty={"d": 1.0}).table(spark)


@query("negbin_glm")
def negbin(spark, sf):
    ep = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"]).withColumn("x", shrink_rate("prior_s", "prior_n", 0.2, 20))
    f, log_alpha = fit.negative_binomial(ep, ["x"], "n")
    return f.table(spark).withColumn("log_alpha", F.lit(log_alpha))


@query("hazard_states", f"WITH {EPISODES}, x AS (SELECT entity, day, n, unnest(range(0, 4)) AS part FROM ep), y AS (SELECT * FROM x WHERE n >= part * 2) SELECT entity, day, CAST(part AS INTEGER) AS part, CAST(n >= (part + 1) * 2 AS INTEGER) AS completed, CASE WHEN n >= (part + 1) * 2 AND part < 3 THEN CAST(n > (part + 1) * 2 AS INTEGER) END AS returned, CASE WHEN n < (part + 1) * 2 THEN n - part * 2 END AS partial FROM y")
def hazard_states(spark, sf):
    return fit.hazard_states(episodes(spark, sf), "n", ["entity", "day"], 4, 2).select("entity", "day", "part", "completed", "returned", "partial")


@query("hazard_fit")
def hazard_fit(spark, sf):
    s = fit.hazard_states(episodes(spark, sf).withColumn("x", F.col("v") / 100), "n", ["entity", "x"], 4, 2)
    s = s.withColumns({f"part{j}": (F.col("part") == j).cast("double") for j in range(4)} | {f"x_part{j}": F.when(F.col("part") == j, F.col("x")).otherwise(0.0) for j in range(4)})
    names = [f"part{j}" for j in range(4)] + ["x"] + [f"x_part{j}" for j in range(4)]
    return fit.logistic(s, names, "completed", penalty={f"x_part{j}": 30.0 for j in range(4)}, intercept=False).table(spark)


@query("survival_shape_test")
def shape_test(spark, sf):
    from priorframe.operators.aggregates import hazard_table

    t = hazard_table(episodes(spark, sf).withColumn("n", F.col("n").cast("int")), "n", "epoch", 8).filter("epoch = 'ALL' and at_risk > 0")
    t = t.withColumn("even", (F.col("k") % 2 == 0).cast("double"))
    small, large = fit.logistic(t, ["k"], "stopped", "at_risk"), fit.logistic(t, ["k", "even"], "stopped", "at_risk")
    return spark.createDataFrame([(2 * (large.loglik - small.loglik), 1, -2 * large.loglik + 6)], "lr double, dof int, aic double")


@query("design_spec", f"WITH {PREDS}, t AS (SELECT CASE WHEN k % 9 = 0 THEN NULL ELSE value END AS v, k FROM pr WHERE epoch <= 2) SELECT 'v' AS term, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS sd, CAST(count(*) - count(v) AS BIGINT) AS missing FROM t UNION ALL SELECT 'k', round(avg(k), 6), round(stddev_pop(k), 5), CAST(count(*) - count(k) AS BIGINT) FROM t")
def spec(spark, sf):
    t = preds(spark, sf).filter("epoch <= 2").withColumn("v", F.when(F.col("k") % 9 != 0, F.col("value")))
    s = fit.design_spec(t, ["v", "k"])
    return spark.createDataFrame([(c, round(x["mean"], 6), round(x["sd"], 5), x["missing"]) for c, x in s.items()], "term string, mean double, sd double, missing long")


@query("grid_fit", f"WITH {EPISODES}, a AS (SELECT *, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT unnest(range(0, 41)) * 5.0::DOUBLE + 1 AS w), q AS (SELECT w, n, s, (ps + w * 0.2) / (pn + w) AS p FROM a, g) SELECT w, round(-sum(s * ln(greatest(p, 1e-9)) + (n - s) * ln(greatest(1 - p, 1e-9))) / sum(n), 7) AS loss FROM q GROUP BY w")
def grid(spark, sf):
    a = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"])
    return fit.grid_fit(a, lambda w: (F.col("prior_s") + w * 0.2) / (F.col("prior_n") + w), ["prior_n", "prior_s"], "s", "n", "w", 1.0, 201.0, 41).select("w", r("loss", 7))


@query("lambda_select")
def lambda_select(spark, sf):
    rows = preds(spark, sf).withColumn("z", F.col("value") / 100)
    days = rows.select("day").distinct().withColumn("q", F.percent_rank().over(Window.orderBy("day")))
    rows = rows.join(days, "day")
    out = []
    for lam in (0.0, 3.0, 30.0):
        f = fit.logistic(rows.filter("q < 0.7"), ["z"], "y", penalty={"z": lam})
        out.append((lam, rows.filter("q >= 0.7").agg(F.avg(F.pow(sigmoid(f.predictor()) - F.col("y"), F.lit(2.0)))).first()[0]))
    return spark.createDataFrame(out, "lambda double, brier double")


@query("isotonic_fit", f"""WITH {PREDS}, t AS (SELECT p, y, event_id, row_number() OVER (ORDER BY p, event_id) - 1 AS rk, count(*) OVER () AS n FROM pr WHERE event_id % 2 = 0), c AS (SELECT rk // greatest(1, n // 20) AS b, avg(p) AS x, avg(y) AS y, count(*) AS n FROM t GROUP BY 1),
  m AS (SELECT i.b AS lo, j.b AS hi, sum(c.y * c.n) / sum(c.n) AS v FROM c AS i JOIN c AS j ON j.b >= i.b JOIN c ON c.b BETWEEN i.b AND j.b GROUP BY ALL), low AS (SELECT c.b, m.lo, min(m.v) AS v FROM c JOIN m ON m.lo <= c.b AND m.hi >= c.b GROUP BY ALL), lv AS (SELECT b, max(v) AS v FROM low GROUP BY b),
  k AS (SELECT round(lv.v, 12) AS g, sum(x * n) / sum(n) AS x, max(lv.v) AS v FROM c JOIN lv USING (b) GROUP BY 1), kn AS (SELECT x, v, lead(x) OVER w AS x1, lead(v) OVER w AS v1, row_number() OVER w AS i FROM k WINDOW w AS (ORDER BY x))
  SELECT event_id, round(greatest(least(coalesce(CASE WHEN kn.x1 IS NULL THEN kn.v ELSE kn.v + (pr.p - kn.x) / (kn.x1 - kn.x) * (kn.v1 - kn.v) END, (SELECT min(v) FROM kn)), 1 - 1e-3), 1e-3) + 1e-9, 5) AS calibrated FROM pr LEFT JOIN kn ON pr.p >= kn.x AND (kn.x1 IS NULL OR pr.p < kn.x1) WHERE event_id % 2 = 1""")
def isotonic(spark, sf):
    rows = preds(spark, sf)
    knots = fit.isotonic_fit(rows.filter("event_id % 2 = 0"), "p", "y", ["event_id"], 20)
    return rows.filter("event_id % 2 = 1").select("event_id", F.round(fit.isotonic_predict(F.col("p"), knots) + 1e-9, 5).alias("calibrated"))


@query("score_batch", f"""WITH RECURSIVE {EPISODES}, a AS (SELECT entity, day, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  st AS (SELECT DISTINCT pn, ps, (ps + 20 * 0.2::DOUBLE) / (pn + 20) AS rate, 4 + pn / 20.0::DOUBLE AS mu FROM a), t AS (SELECT pn, ps, n, exp(lgamma(n + 20.0) - lgamma(20.0) - lgamma(n + 1) + 20 * ln(20 / (20 + mu)) + n * ln(mu / (20 + mu))) AS w FROM (SELECT *, unnest(range(0, 16)) AS n FROM st)), tw AS (SELECT pn, ps, n, w / sum(w) OVER (PARTITION BY pn, ps) AS w FROM t),
  rec AS (SELECT pn, ps, rate, CAST(0 AS BIGINT) AS n, [1.0::DOUBLE] AS pmf FROM st UNION ALL SELECT pn, ps, rate, n + 1, [coalesce(pmf[i], 0) * (1 - least(rate * (1 - 0.01::DOUBLE * n), 0.99)) + coalesce(pmf[i - 1], 0) * least(rate * (1 - 0.01::DOUBLE * n), 0.99) for i in range(1, len(pmf) + 2)] FROM rec WHERE n < 15),
  d AS (SELECT pn, ps, sum(w * (1 - pmf[1])) AS a, sum(w * (1 - pmf[1] - coalesce(pmf[2], 0))) AS b, sum(w * (1 - pmf[1] - coalesce(pmf[2], 0) - coalesce(pmf[3], 0))) AS c FROM rec JOIN tw USING (pn, ps, n) GROUP BY ALL)
  SELECT entity, day, round(d.a + 1e-10, 7) AS over_0, round(d.b + 1e-10, 7) AS over_1, round(d.c + 1e-10, 7) AS over_2 FROM a JOIN d USING (pn, ps)""")
def score_batch(spark, sf):
    """Features to trial-count pmf, unit probabilities, success pmf and line probabilities: column expressions alone."""
    ep = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"]).select("entity", "day", "prior_n", "prior_s")
    # Many rows share a state: each is scored once. Each step is a column of its own, so that the folds below refer to it and do not compute it again.
    x = ep.select("prior_n", "prior_s").distinct().withColumn("rate", shrink_rate("prior_s", "prior_n", 0.2, 20)).withColumn("trials", X.normalize(X.negbin_pmf(4 + F.col("prior_n") / 20, F.lit(0.05), 15)))
    x = x.withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.least(F.col("rate") * (1 - 0.01 * i), F.lit(0.99))))
    x = x.withColumn("pmf", X.compound(F.col("probs"), F.col("trials")))
    x = x.select("prior_n", "prior_s", *(F.round(X.tail_above(F.col("pmf"), F.lit(v)) + 1e-10, 7).alias(n) for n, v in (("over_0", 0.5), ("over_1", 1.5), ("over_2", 2.5))))
    return ep.join(x, ["prior_n", "prior_s"]).select("entity", "day", "over_0", "over_1", "over_2")


def screen_rows(spark, sf):
    return preds(spark, sf).withColumn("signal", F.col("value") + 20 * F.col("y")).withColumn("noise", F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000)


@query("factor_screen")
def screen(spark, sf):
    out = E.factor_screen(screen_rows(spark, sf), ["k"], ["signal", "noise"], "y", F.col("epoch") <= 2)
    return spark.createDataFrame([(x["candidate"], float(x["gain"]), float(x["t"]), float(x["residual_r"])) for x in out], "candidate string, gain double, t double, residual_r double")


@query("noise_floor")
def floor(spark, sf):
    return spark.createDataFrame([(E.noise_floor(screen_rows(spark, sf), ["k"], "event_id", "y", [F.col("epoch") <= e for e in (1, 2, 3)]),)], "floor double")


@query("backtest")
def backtest(spark, sf):
    e = F.col("epoch")
    return E.backtest(screen_rows(spark, sf), {"1": (e <= 1, e == 2), "2": (e <= 2, e == 3), "3": (e <= 3, e >= 4)}, ["signal", "k"], "y", "b")


@query("backtest_by_line")
def backtest_by_line(spark, sf):
    e = F.col("epoch")
    return E.backtest(screen_rows(spark, sf), {"1": (e <= 1, e == 2), "2": (e <= 2, e == 3), "3": (e <= 3, e >= 4)}, ["signal", "k"], "y", "b", "line")


@query("regauntlet_drop_one")
def regauntlet(spark, sf):
    return E.drop_one(screen_rows(spark, sf), F.col("epoch") <= 2, ["signal", "noise"], "y")


@query("effect_directions")
def directions(spark, sf):
    rows = screen_rows(spark, sf)
    f = fit.logistic(rows, ["signal", "noise"], "y")
    return spark.createDataFrame([(x["term"], x["shift"], x["verdict"]) for x in E.effect_directions(rows, f, {"signal": 1, "noise": -1, "career": 1})], "term string, shift double, verdict string")


@query("prior_season_gate", f"""WITH {EPISODES}, t AS (SELECT entity, epoch, sum(n) AS last_n, sum(s) AS last_s FROM ep GROUP BY ALL), a AS (SELECT *, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM ep WINDOW w AS (PARTITION BY entity, epoch ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  x AS (SELECT CASE WHEN last_n IS NULL THEN 'debut' WHEN last_n < 12 THEN 'thin' ELSE 'full' END AS "group", a.s / a.n::DOUBLE AS y, (ps + 20 * 0.2::DOUBLE) / (pn + 20) AS wo, (ps + 20 * ((coalesce(last_s, 0) + 20 * 0.2::DOUBLE) / (coalesce(last_n, 0) + 20))) / (pn + 20) AS wi FROM a LEFT JOIN t ON t.entity = a.entity AND t.epoch + 1 = a.epoch),
  d AS (SELECT *, (wi - y) * (wi - y) AS bi, (wo - y) * (wo - y) AS bo FROM x), g AS (SELECT "group", count(*) AS n, avg(bi) AS bi, avg(bo) AS bo, avg(bo - bi) AS gain, stddev_samp(bo - bi) / sqrt(count(*)) AS se FROM d GROUP BY "group")
  SELECT "group", n, round(bi, 6) AS brier_with, round(bo, 6) AS brier_without, round(gain, 7) AS gain, round(CASE WHEN se > 1e-12 THEN gain / se ELSE 0 END, 3) AS z FROM g""")
def season_gate(spark, sf):
    """What last epoch's rate adds to the as-of rate: paired by row, by how much of last epoch is known."""
    ep = asof.prior_sums(episodes(spark, sf), ["entity", "epoch"], ["day"], ["n", "s"])
    last = asof.previous_epoch(episodes(spark, sf), "entity", "epoch", ["n", "s"]).select("entity", "epoch", "last_n", "last_s")
    x = ep.join(last, ["entity", "epoch"]).withColumn("y", F.col("s") / F.col("n")).withColumn("without", shrink_rate("prior_s", "prior_n", 0.2, 20))
    x = x.withColumn("prior", shrink_rate("last_s", "last_n", 0.2, 20)).withColumn("with_prior", shrink_rate("prior_s", "prior_n", "prior", 20))
    x = x.withColumn("group", F.when(F.col("last_n").isNull(), "debut").when(F.col("last_n") < 12, "thin").otherwise("full"))
    return E.paired_by_group(x, ["group"], "with_prior", "without", "y").select("group", "n", r("brier_a", 6).alias("brier_with"), r("brier_b", 6).alias("brier_without"), r("gain", 7), r("z", 3))


@query("daily_board", f"""WITH RECURSIVE {EPISODES}, a AS (SELECT entity, day, (coalesce(sum(s) OVER w, 0) + 20 * 0.3::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 20) AS prob FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  qu AS (SELECT entity, day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(k, (ts, event_id)) AS k FROM log WHERE kind = 'view' GROUP BY ALL), pr AS (SELECT qu.*, prob, 100.0::DOUBLE / (200 + k) AS io, (110.0::DOUBLE + k) / (210 + k) AS iu FROM qu JOIN a USING (entity, day)),
  f AS (SELECT *, io / (io + iu) AS fair, io + iu - 1 AS hold FROM pr), g AS (SELECT *, 0.5 * (prob - fair) AS gain, 0.5 * prob + 0.5 * fair AS bl FROM f), h AS (SELECT *, abs(bl - fair) AS edge, CASE WHEN gain >= -gain THEN 1 / io ELSE 1 / iu END AS dec, CASE WHEN gain >= -gain THEN bl ELSE 1 - bl END AS bp, greatest(hold + 0.02, 0.03) AS threshold FROM g),
  i AS (SELECT *, edge >= threshold AND bp * dec - 1 >= 0.04 AS play, greatest(0, least(2, 25 * ((dec - 1) * bp - (1 - bp)) / (dec - 1))) AS raw FROM h),
  given_bets AS (SELECT day, event_id AS bet, entity AS episode, edge, CASE WHEN NOT play OR raw < 0.125 THEN 0 WHEN raw < 0.375 THEN 0.25 WHEN raw < 0.75 THEN 0.5 ELSE least(round_even(raw, 0), 2) END::DOUBLE AS stake FROM i), {cap_sql('given_bets', 'BIGINT')}
  SELECT day, bet AS event_id, units, capped FROM capped""")
def daily_board(spark, sf):
    """Quotes joined as-of with entity state, priced, staked and capped by day."""
    state = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"]).select("entity", "day", shrink_rate("prior_s", "prior_n", 0.3, 20).alias("prob"))
    quotes = M.last_capture(log(spark, sf).filter("kind = 'view'"), ["entity", "day"], "ts", "event_id").select("entity", "day", "event_id", (100 + F.col("k")).alias("over"), (-110 - F.col("k")).alias("under"))
    priced = M.evaluate_edges(quotes.join(state, ["entity", "day"]).select("entity", "day", "event_id", "over", "under", "prob"), "prob", "over", "under")
    capped = M.portfolio_cap(priced.select("day", "event_id", "entity", "stake", "edge"), "day", "event_id", "entity", "stake", "edge")
    return capped.select("day", "event_id", "units", "capped")


@query("publish_slates", f"WITH {LOG}, sl AS (SELECT DISTINCT day, entity FROM log WHERE kind = 'view'), le AS (SELECT day, entity, max(value) AS stake FROM log WHERE kind = 'purchase' GROUP BY ALL), oc AS (SELECT day, entity, max(k) AS actual FROM log WHERE kind = 'click' GROUP BY ALL), u AS (SELECT day, entity FROM sl UNION SELECT day, entity FROM le) SELECT day, entity, stake, actual, (day, entity) IN (SELECT (day, entity) FROM sl) AS on_slate FROM u LEFT JOIN le USING (day, entity) LEFT JOIN oc USING (day, entity)")
def publish(spark, sf):
    e, keys = log(spark, sf), ["day", "entity"]
    slate = e.filter("kind = 'view'").select(*keys).distinct().withColumn("on_slate", F.lit(True))
    ledger = e.filter("kind = 'purchase'").groupBy(*keys).agg(F.max("value").alias("stake"))
    outcome = e.filter("kind = 'click'").groupBy(*keys).agg(F.max("k").alias("actual"))
    return slate.join(ledger, keys, "full_outer").join(outcome, keys, "left").select(*keys, "stake", "actual", F.coalesce("on_slate", F.lit(False)).alias("on_slate"))


# --- quality ---------------------------------------------------------------------------------------


@query("quality_report", f"WITH {BETS} SELECT 'pnl_drift' AS check, CASE WHEN count(*) FILTER (bet % 97 = 0) = 0 THEN 'ok' ELSE 'fail' END AS status, CAST(count(*) FILTER (bet % 97 = 0) AS BIGINT) AS n, count(*) AS rows FROM bets UNION ALL SELECT 'odds_provenance', 'ok', CAST(0 AS BIGINT), count(*) FROM bets UNION ALL SELECT 'basis_guard', CASE WHEN count(*) FILTER (strength = 'BUILDING') = 0 THEN 'ok' ELSE 'fail' END, CAST(count(*) FILTER (strength = 'BUILDING') AS BIGINT), count(*) FROM bets UNION ALL SELECT 'probability_saturation', CASE WHEN count(*) FILTER (prob >= 0.8) = 0 THEN 'ok' ELSE 'fail' END, CAST(count(*) FILTER (prob >= 0.8) AS BIGINT), count(*) FROM bets UNION ALL SELECT 'ledger_monotonic', 'ok', CAST(0 AS BIGINT), count(*) FROM bets")
def quality(spark, sf):
    from priorframe.functions.prices import profit

    b = bets(spark, sf).withColumn("gain", profit("grade", "stake", "odds")).withColumn("stored", F.when(F.col("bet") % 97 == 0, F.col("gain") + 0.5).otherwise(F.col("gain")))
    basis = F.when(F.col("strength") == "BUILDING", "other").otherwise("flat")
    reports = [Q.report(b, "pnl_drift", F.abs(F.col("gain") - F.col("stored")) > 0.005, "bet"), Q.report(b, "odds_provenance", F.col("odds").isNull(), "bet"), Q.report(b, "basis_guard", basis != "flat", "bet"), Q.report(b, "probability_saturation", F.col("prob") >= 0.8, "bet"), Q.monotonic(b, 1)]
    return Q.union_reports(reports).select("check", "status", F.col("n").cast("long").alias("n"), "rows")


@query("board_complete", f"WITH {LOG} SELECT day, count(*) AS rows, round(avg(CASE WHEN k > 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS priced, count(DISTINCT entity) < 4 AS collapsed FROM log GROUP BY day")
def board_complete(spark, sf):
    return log(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((F.col("k") > 10).cast("double")), 6).alias("priced"), (F.countDistinct("entity") < 4).alias("collapsed"))


@query("log_coverage", f"WITH {LOG} SELECT DISTINCT day FROM log WHERE DATE '2024-01-29' - day > 2 AND day NOT IN (SELECT day FROM log WHERE entity = 3)")
def coverage(spark, sf):
    e = log(spark, sf)
    return Q.coverage(e, e.filter("entity = 3"), "day", "2024-01-29", 2)


@query("freshness", f"WITH {LOG}, s AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT day, count(*) AS rows FROM log GROUP BY day) SELECT day, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'absent' ELSE 'real' END AS status FROM s LEFT JOIN n USING (day)")
def freshness(spark, sf):
    return Q.freshness(log(spark, sf), "day", "2023-12-28", "2024-02-03")


@query("reconcile_sources", f"WITH {EPISODES}, a AS (SELECT entity, day, n FROM ep WHERE entity % 7 <> 0), b AS (SELECT entity, day, n + CASE WHEN entity % 11 = 0 THEN 1 ELSE 0 END AS n FROM ep WHERE entity % 5 <> 0) SELECT entity, day, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'unknown' WHEN a.n = b.n THEN 'confirmed' ELSE 'disagree' END AS verdict FROM a FULL JOIN b USING (entity, day)")
def reconcile(spark, sf):
    ep = episodes(spark, sf)
    return Q.reconcile(ep.filter("entity % 7 <> 0"), ep.filter("entity % 5 <> 0").withColumn("n", F.col("n") + (F.col("entity") % 11 == 0).cast("int")), ["entity", "day"], "n")


@query("publish_matches_ledger", f"WITH {BETS} SELECT round(sum(stake), 3) AS ledger, round(sum(stake) FILTER (bet % 1000 <> 7), 3) AS published, abs(sum(stake) - sum(stake) FILTER (bet % 1000 <> 7)) < 0.005 AS matches FROM bets")
def matches(spark, sf):
    s = bets(spark, sf).agg(F.sum("stake").alias("a"), F.sum(F.when(F.col("bet") % 1000 != 7, F.col("stake"))).alias("b"))
    return s.select(F.round("a", 3).alias("ledger"), F.round("b", 3).alias("published"), (F.abs(F.col("a") - F.col("b")) < 0.005).alias("matches"))


# --- streams ---------------------------------------------------------------------------------------


def event_stream(spark, sf):
    e = live.stream(spark, f"{sf}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("live_latest_state", f"WITH {LOG}, f AS (SELECT *, kind = 'signup' AS final FROM log) SELECT entity, day, arg_max(value, (final::INT, event_id)) AS value, bool_or(final) AS final, count(*) AS polls FROM f GROUP BY ALL")
def live_state(spark, sf):
    rows = event_stream(spark, sf).withColumn("final", F.col("kind") == "signup")
    return live.run_complete(live.latest_state(rows, ["entity", "day"], "event_id", ["value"], "final"), "live")


@query("closing_line_stream", f"WITH {LOG} SELECT entity, day, arg_max(value, ts) AS close FROM log WHERE ts <= day + INTERVAL 15 HOUR GROUP BY ALL")
def closing_stream(spark, sf):
    rows = event_stream(spark, sf).withColumn("start", F.col("day").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
    return live.run_complete(live.closing_lines(rows, ["entity", "day"], "ts", "start", "value"), "closing").select("entity", "day", "close")


@query("windowed_stream", f"WITH {LOG} SELECT kind, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM log GROUP BY ALL")
def windowed_stream(spark, sf):
    rows = event_stream(spark, sf).groupBy("kind", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return live.run_complete(rows, "windows").select("kind", F.col("w.start").alias("start"), "n", r("total", 4))


@query("settled_flag", f"WITH {LOG}, o AS (SELECT day, list(k ORDER BY t, k) AS ord FROM (SELECT day, k, min(event_id) AS t FROM log GROUP BY ALL) GROUP BY day) SELECT event_id, list_position(ord, (k + 1) % 100) IS NOT NULL AS appeared, kind = 'signup' OR coalesce(list_position(ord, (k + 1) % 100) < len(ord), false) AS settled FROM log JOIN o USING (day)")
def settled(spark, sf):
    e = log(spark, sf)
    order = slates.appearances(e, ["day"], "k", "event_id").withColumnRenamed("k", "actor")
    rows = e.withColumn("actor", (F.col("k") + 1) % 100).withColumn("terminal", F.col("kind") == "signup")
    return slates.settled_flag(rows, order, ["day"], "actor", "terminal").select("event_id", "appeared", "settled")


@query("carryover_timeout", f"WITH {LOG}, d AS (SELECT day, bool_and(kind <> 'error') AS done FROM log GROUP BY day) SELECT day, done, day = DATE '2024-01-21' OR (day = DATE '2024-01-20' AND NOT done) AS active FROM d")
def carryover(spark, sf):
    return slates.carried_keys(log(spark, sf).withColumn("final", F.col("kind") != "error"), "day", "final", "2024-01-21 03:00:00", 6)


@query("late_data_refetch", f"WITH {LOG} SELECT day, count(*) AS rows, DATE '2024-01-30' - day >= 2 AS is_final FROM log GROUP BY day")
def late(spark, sf):
    return slates.late_days(log(spark, sf), "day", "2024-01-30")
