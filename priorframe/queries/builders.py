"""Queries of the feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.operators import aggregates as A
from priorframe.operators import joins as J
from priorframe.plans import features as B
from priorframe.queries.base import BULK_DAYS, EPISODES, LOG, bulk_days, episodes, log, query, r

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("pitcher_asof_table", f"""WITH {BULK_DAYS}, a AS (SELECT *, count(*) OVER w AS games, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS pn, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS ps, avg(n) OVER w AS mn, CASE WHEN count(n) OVER w > 1 THEN stddev_samp(n) OVER w END AS sdn,
    CAST(day - lag(day) OVER w2 AS INTEGER) AS since FROM bd WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR}), w2 AS (PARTITION BY entity, epoch ORDER BY day))
  SELECT entity, day, CAST(games AS BIGINT) AS prior_games, pn AS prior_n, ps AS prior_s, round(CASE WHEN pn > 0 THEN ps / pn::DOUBLE END, 6) AS asof_rate, round((ps + 70 * 0.225::DOUBLE) / (pn + 70), 6) AS asof_shrunk, round(mn, 6) AS prior_mean, round(sdn, 5) AS prior_std, since AS days_since_prior FROM a""")
def pitcher_table(spark, sf):
    x = B.entity_asof_table(bulk_days(spark, sf), "entity", "epoch", "day", "n", "s", 70, 0.225, "n")
    return x.select("entity", "day", "prior_games", "prior_n", "prior_s", r("asof_rate"), r("asof_shrunk"), r("prior_mean"), r("prior_std", 5), "days_since_prior")


@query("batter_asof_table", f"""WITH {LOG}, d AS (SELECT k, day, count(*) AS n, sum(success) AS s FROM log GROUP BY ALL), a AS (SELECT k, day, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS pn, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS ps FROM d WINDOW w AS (PARTITION BY k ORDER BY day {PRIOR}))
  SELECT k, day, pn AS prior_n, ps AS prior_s, round((ps + 60 * 0.225::DOUBLE) / (pn + 60), 6) AS asof_shrunk FROM a""")
def batter_table(spark, sf):
    d = log(spark, sf).groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("s")).withColumn("epoch", F.lit(1))
    return B.entity_asof_table(d, "k", "epoch", "day", "n", "s", 60, 0.225).select("k", "day", "prior_n", "prior_s", r("asof_shrunk"))


@query("outs_asof", f"""WITH {BULK_DAYS}, f AS (SELECT *, CAST(n = 2 AS INTEGER) AS at2, CAST(n >= 2 AS INTEGER) AS to2 FROM bd), l AS (SELECT epoch, day, sum(n) AS n, count(*) AS g, sum(at2) AS a, sum(to2) AS t FROM f GROUP BY ALL),
  lp AS (SELECT epoch, day, coalesce(sum(n) OVER w, 0) AS ln, coalesce(sum(g) OVER w, 0) AS lg, coalesce(sum(a) OVER w, 0) AS la, coalesce(sum(t) OVER w, 0) AS lt FROM l WINDOW w AS (PARTITION BY epoch ORDER BY day {PRIOR})),
  e AS (SELECT entity, epoch, day, coalesce(sum(n) OVER w, 0) AS pn, count(*) OVER w AS pg, coalesce(sum(at2) OVER w, 0) AS pa, coalesce(sum(to2) OVER w, 0) AS pt FROM f WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR}))
  SELECT entity, day, round(CASE WHEN pg > 0 THEN pn / pg::DOUBLE END, 6) AS level, round((pn + CASE WHEN lg > 0 THEN ln / lg::DOUBLE END) / (pg + 1) + 1e-8, 5) AS level_shrunk, round((pa + 24 * ((la + 20) / (lt + 200)::DOUBLE)) / (pt + 24), 6) AS stop_2, round(CASE WHEN lg > 0 THEN ln / lg::DOUBLE END + 1e-8, 5) AS league_mean FROM e JOIN lp USING (epoch, day)""")
def outs_asof(spark, sf):
    x = B.exposure_features(bulk_days(spark, sf), "entity", "epoch", "day", "n", "q", (2,))
    return x.select("entity", "day", r("level"), F.round(F.col("level_shrunk") + 1e-8, 5).alias("level_shrunk"), r("stop_2"), F.round(F.col("league_mean") + 1e-8, 5).alias("league_mean"))


@query("park_rate", f"""WITH {EPISODES}, d AS (SELECT entity % 6 AS park, epoch, day, sum(n) AS n, sum(s) AS s FROM ep GROUP BY ALL), l AS (SELECT epoch, day, sum(n) AS n, sum(s) AS s FROM d GROUP BY ALL),
  lp AS (SELECT epoch, day, coalesce(sum(s) OVER w, 0) / nullif(sum(n) OVER w, 0)::DOUBLE AS q FROM l WINDOW w AS (PARTITION BY epoch ORDER BY day {PRIOR})), p AS (SELECT park, epoch, day, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps, count(*) OVER w AS days FROM d WINDOW w AS (PARTITION BY park, epoch ORDER BY day {PRIOR}))
  SELECT park, epoch, day, round(CASE WHEN days >= 3 THEN (ps + 400 * q) / (pn + 400) END, 6) AS rate FROM p JOIN lp USING (epoch, day)""")
def park(spark, sf):
    return B.place_rate(episodes(spark, sf).withColumn("park", F.col("entity") % 6), "park", "epoch", "day", "n", "s", 400, 3).select("park", "epoch", "day", r("rate"))


@query("workload_features", f"""WITH {EPISODES} SELECT entity, day, round(coalesce(sum(n) OVER a, 0), 4) AS load15, max(n) OVER b AS max5, round(avg(n) OVER b, 6) AS mean5, round(avg(CASE WHEN n < 3 THEN 1.0::DOUBLE ELSE 0 END) OVER c, 6) AS short_share FROM ep
  WINDOW a AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY entity ORDER BY day {PRIOR})""")
def workload(spark, sf):
    x = B.workload_features(episodes(spark, sf), "entity", "day", "n")
    return x.select("entity", "day", F.round(F.col("load15").cast("double"), 4).alias("load15"), "max5", r("mean5"), r("short_share"))


@query("form_features", f"""WITH {LOG}, f AS (SELECT *, CAST(kind = 'error' AS INTEGER) AS whiff FROM log), d AS (SELECT entity, day, count(*) AS t, sum(success) AS s, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM f GROUP BY entity, day),
  l AS (SELECT entity, sum(s) FILTER (rn <= 5) / sum(t) FILTER (rn <= 5)::DOUBLE AS l5, sum(s) FILTER (rn <= 10) / sum(t) FILTER (rn <= 10)::DOUBLE AS l10 FROM d GROUP BY entity), b AS (SELECT entity, count(*) AS n, avg(whiff) AS w, avg(CASE WHEN kind IN ('view', 'click') THEN 1.0::DOUBLE ELSE 0 END) AS fs FROM f GROUP BY entity)
  SELECT entity, n, round(w, 6) AS whiff_rate, round(fs, 6) AS fast_share, round(l5, 6) AS last5, round(l5 - l10, 6) AS trend FROM b JOIN l USING (entity)""")
def form(spark, sf):
    e = A.classify(log(spark, sf), "kind", {"swing": ("click", "purchase", "error"), "whiff": ("error",)})
    x = B.form_features(e, "entity", "day", "kind", "swing", "whiff", "success", "value", ("view", "click"))
    return x.select("entity", "n", r("whiff_rate"), r("fast_share"), r("last5"), r("trend"))


@query("stage_training_set", f"""WITH {BULK_DAYS}, a AS (SELECT entity, day, n, count(*) OVER w AS games, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps FROM bd WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR})) SELECT entity, day, n, round(ps / pn::DOUBLE, 6) AS asof_rate FROM a WHERE n >= 2 AND games >= 3 AND pn > 0""")
def training(spark, sf):
    d = bulk_days(spark, sf)
    x = B.entity_asof_table(d, "entity", "epoch", "day", "n", "s", 70, 0.225).select("entity", "day", "prior_games", "asof_rate")
    return B.training_set(d.select("entity", "day", "n"), x, ["entity", "day"], 2, 3).select("entity", "day", "n", r("asof_rate"))


@query("design_assembly", f"""WITH {LOG}, s AS (SELECT day, k % 2 AS side, arg_min(entity, event_id) AS entity FROM log GROUP BY ALL), d AS (SELECT entity, day, count(*) AS n FROM log GROUP BY ALL), p AS (SELECT entity, day, CAST(coalesce(sum(n) OVER (PARTITION BY entity ORDER BY day {PRIOR}), 0) AS BIGINT) AS pn FROM d),
  j AS (SELECT s.day, s.entity, p.pn FROM s JOIN p USING (entity, day)) SELECT a.day, a.entity, a.pn AS own, b.pn AS opp FROM j a JOIN j b ON a.day = b.day AND a.entity <> b.entity""")
def assembly(spark, sf):
    e = log(spark, sf)
    s = e.groupBy("day", (F.col("k") % 2).alias("side")).agg(F.min_by("entity", "event_id").alias("entity"))
    d = e.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    j = J.assemble(s, [d.select("entity", "day", own.alias("own"))], ["entity", "day"])
    return J.opposing(j, ["day"], "entity", ["own"]).select("day", "entity", "own", F.col("opp_own").alias("opp"))
