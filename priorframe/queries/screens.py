"""Queries of screens, deep dives, analytics, reconstruction and refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.functions.rates import shrink_rate
from priorframe.operators import asof, market as M
from priorframe.plans import evaluate as E, features as B, fit
from priorframe.queries.base import BULK_DAYS, EPISODES, LOG, bulk_days, episodes, log, query, r
from priorframe.queries.models import PREDS, preds

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def near(column: str, digits: int = 6):
    """Rounded, a half moved off the edge."""
    return F.round(F.col(column) + 1e-9, digits).alias(column)


@query("ranked_screen", f"""WITH {PREDS}, sp AS (SELECT * FROM (VALUES (1), (2), (3)) t(s)), c AS (SELECT s, epoch <= s AS train, y, unnest(['signal', 'k', 'value']) AS candidate, unnest([value + 20 * y, k, value]) AS x FROM pr, sp WHERE epoch <= s + 1),
  m AS (SELECT s, candidate, avg(y) AS mean, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM c WHERE train GROUP BY ALL), g AS (SELECT s, candidate, avg((mean - y) * (mean - y) - (a + b * x - y) * (a + b * x - y)) AS gain, corr(x, y - mean) AS rr FROM c JOIN m USING (s, candidate) WHERE NOT train GROUP BY ALL),
  w AS (SELECT candidate, min(gain) AS worst, bool_and(CASE candidate WHEN 'signal' THEN rr > 0 WHEN 'k' THEN rr < 0 ELSE true END) AS sign_matches FROM g GROUP BY candidate)
  SELECT candidate, round(worst, 6) AS worst, sign_matches, worst > 0.0001 AND sign_matches AS survives, CAST(row_number() OVER (ORDER BY worst DESC, candidate) AS INTEGER) AS place FROM w""")
def ranked_screen(spark, sf):
    rows = preds(spark, sf).withColumn("signal", F.col("value") + 20 * F.col("y"))
    e = F.col("epoch")
    out = E.ranked_screen(rows, [], {"signal": 1, "k": -1, "value": 0}, "y", [(e <= s, e == s + 1) for s in (1, 2, 3)], 0.0001)
    found = [(x["candidate"], round(x["worst"], 6), x["sign_matches"], x["survives"], i + 1) for i, x in enumerate(out)]
    return spark.createDataFrame(found, "candidate string, worst double, sign_matches boolean, survives boolean, place int")


@query("blend_weight", f"WITH {PREDS}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w), s AS (SELECT avg((p - b) * (y - b)) / avg((p - b) * (p - b)) AS best FROM pr) SELECT w, round(avg((b + w * (p - b) - y) * (b + w * (p - b) - y)), 6) AS brier, round(any_value(best), 6) AS best FROM pr, w, s GROUP BY w")
def blend_weight(spark, sf):
    return E.blend_weight(preds(spark, sf), "p", "b", "y").select("w", r("brier"), r("best"))


@query("market_residual", f"WITH {PREDS}, x AS (SELECT p - b AS v, y - b AS r FROM pr), s AS (SELECT regr_slope(r, v) * stddev_samp(v) AS slope, corr(v, r) AS r, stddev_samp(r) AS sd, count(*) AS n FROM x) SELECT round(slope, 6) AS slope, round(sqrt((1 - r * r) / (n - 2)) * sd, 6) AS se, round(slope / (sqrt((1 - r * r) / (n - 2)) * sd), 5) AS t, round(r, 6) AS r, n FROM s")
def market_residual(spark, sf):
    x = E.market_residual(preds(spark, sf), F.col("p") - F.col("b"), F.col("y") - F.col("b"))
    return x.select(r("slope"), r("se"), r("t", 5), r("r"), "n")


SWEEP = " UNION ALL ".join(f"SELECT {n} AS length, count(m{n}) AS n, round(corr(m{n}, q), 6) AS r FROM x" for n in (3, 5, 10, 20))


@query("window_sweep", f"WITH {BULK_DAYS}, x AS (SELECT q, " + ", ".join(f"CASE WHEN count(q) OVER w{n} >= {max(1, n // 2)} THEN avg(q) OVER w{n} END AS m{n}" for n in (3, 5, 10, 20)) + " FROM bd WINDOW " + ", ".join(f"w{n} AS (PARTITION BY entity ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 10, 20)) + f") {SWEEP}")
def window_sweep(spark, sf):
    return E.window_sweep(bulk_days(spark, sf), ["entity"], ["day"], "q", (3, 5, 10, 20)).select("length", "n", r("r"))


@query("leak_recount", f"WITH {EPISODES}, x AS (SELECT n, coalesce(sum(n) OVER (PARTITION BY entity ORDER BY day {PRIOR}), 0) AS a, (SELECT coalesce(sum(n), 0) FROM ep b WHERE b.entity = ep.entity AND b.day < ep.day) AS c FROM ep) SELECT count(*) AS rows, CAST(count(*) FILTER (a <> c) AS BIGINT) AS differ, CAST(count(*) FILTER (c + n <> a) AS BIGINT) AS would_leak FROM x")
def leak_recount(spark, sf):
    return E.leak_recount(episodes(spark, sf), "entity", "day", "n")


ANALYTICS = "round(avg((b - y) * (b - y)), 6) AS naive, round(avg((p - y) * (p - y)), 6) AS model, round(avg(p * (1 - p)), 6) AS floor, round(avg((p - y) * (p - y)) - avg(p * (1 - p)), 6) AS excess, round(100 * (1 - avg((p - y) * (p - y)) / avg((b - y) * (b - y))), 4) AS gain_pct, count(*) AS n"


@query("model_analytics", f"WITH {PREDS} SELECT CAST(line AS VARCHAR) AS line, {ANALYTICS} FROM pr GROUP BY line UNION ALL SELECT 'all', {ANALYTICS} FROM pr")
def model_analytics(spark, sf):
    return E.model_analytics(preds(spark, sf), "p", "b", "y", "line").select("line", r("naive"), r("model"), r("floor"), r("excess"), r("gain_pct", 4), "n")


@query("reconstruct_slate", f"""WITH {EPISODES}, q AS (SELECT entity, day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(k, (ts, event_id)) AS k FROM log WHERE kind = 'view' AND ts <= day + INTERVAL 18 HOUR GROUP BY ALL),
  a AS (SELECT entity, day, (coalesce(sum(s) OVER w, 0) + 20 * 0.3::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 20) AS prob FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day {PRIOR})), x AS (SELECT day, entity, event_id, prob, 100.0::DOUBLE / (200 + k) AS io, (110.0::DOUBLE + k) / (210 + k) AS iu FROM q JOIN a USING (entity, day)), f AS (SELECT *, io / (io + iu) AS fair FROM x)
  SELECT day, entity, event_id, round(prob, 6) AS prob, round(fair, 6) AS fair_over, round(abs(0.5 * (prob - fair)), 6) AS edge, CASE WHEN prob >= fair THEN 'OVER' ELSE 'UNDER' END AS best_side, true AS reconstructed FROM f""")
def reconstruct_slate(spark, sf):
    """The board of each day as its evening would have shown it: the last quote by then, the state of strictly earlier days."""
    state = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"]).select("entity", "day", shrink_rate("prior_s", "prior_n", 0.3, 20).alias("prob"))
    known = log(spark, sf).filter("kind = 'view'").filter(F.col("ts") <= F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS"))
    quotes = M.last_capture(known, ["entity", "day"], "ts", "event_id").select("entity", "day", "event_id", (100 + F.col("k")).alias("over"), (-110 - F.col("k")).alias("under"))
    x = M.evaluate_edges(quotes.join(state, ["entity", "day"]), "prob", "over", "under")
    return x.select("day", "entity", "event_id", r("prob"), r("fair_over"), r("edge"), "best_side", F.lit(True).alias("reconstructed"))


@query("retrain", f"""WITH {BULK_DAYS}, a AS (SELECT n, count(*) OVER w AS games, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps FROM bd WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR})), t AS (SELECT n, ps / pn::DOUBLE AS rate FROM a WHERE n >= 1 AND games >= 3 AND pn > 0)
  SELECT 'asof_rate' AS term, round(regr_slope(n, rate), 5) AS coef, count(*) AS n FROM t UNION ALL SELECT '1', round(regr_intercept(n, rate), 5), count(*) FROM t""")
def retrain(spark, sf):
    """A refit on all epochs: as-of state starts anew in each, the rows are fitted together."""
    d = bulk_days(spark, sf)
    x = B.entity_asof_table(d, "entity", "epoch", "day", "n", "s", 70, 0.225).select("entity", "day", "prior_games", "asof_rate")
    rows = B.training_set(d.select("entity", "day", "n"), x, ["entity", "day"], 1, 3)
    f = fit.ols(rows, ["asof_rate"], "n")
    return f.table(spark).select("term", r("coef", 5), F.lit(int(f.n)).cast("long").alias("n"))
