"""Queries of the as-of and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import shrink_rate
from priorframe.operators import aggregates as A, asof, episodes as epi, ranking
from priorframe.queries.base import BULK_DAYS, EPISODES, LOG, bulk_days, episodes, log, query, r


@query("flagship_prior_rate", f"""WITH {EPISODES}, pr AS (SELECT *, coalesce(sum(s) OVER w, 0) AS ps, coalesce(sum(n) OVER w, 0) AS pn FROM ep
    WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT day, n, s, (ps + 20 * 0.2::DOUBLE) / (pn + 20) AS p FROM pr)
  SELECT day, CAST(count(*) AS BIGINT) AS episodes, round(avg(p), 6) AS mean_p, round(sum(n * (p - s / n::DOUBLE) * (p - s / n::DOUBLE)) / sum(n), 6) AS brier FROM f GROUP BY day""")
def flagship(spark, sf):
    """Strictly prior shrunk success rate entering each entity-day, scored against the day's outcome."""
    rows = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"])
    rows = rows.withColumn("p", shrink_rate("prior_s", "prior_n", 0.2, 20))
    miss = F.col("p") - F.col("s") / F.col("n")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.sum(F.col("n") * miss * miss) / F.sum("n"), 6).alias("brier"))


@query("prior_within_group", f"""WITH {EPISODES} SELECT entity, day, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS prior_s
  FROM ep WINDOW w AS (PARTITION BY entity, epoch ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_within_group(spark, sf):
    return asof.prior_sums(episodes(spark, sf), ["entity", "epoch"], ["day"], ["n", "s"]).select("entity", "day", "prior_n", "prior_s")


@query("prior_day_totals", f"""WITH {BULK_DAYS} SELECT entity, day, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS prior_s
  FROM bd WINDOW w AS (PARTITION BY entity, epoch ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_day_totals(spark, sf):
    from priorframe.queries.base import bulk

    rows = bulk(spark, sf).withColumn("n", F.lit(1).cast("long")).withColumn("s", F.col("success").cast("long"))
    return asof.prior_day_totals(rows, ["entity", "epoch"], "day", ["n", "s"]).select("entity", "day", "prior_n", "prior_s")


@query("prior_count_ordinal", f"""WITH {EPISODES}, o AS (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS c,
    min(day) OVER (PARTITION BY entity) <= DATE '2024-01-01' AS cens FROM ep)
  SELECT entity, day, CASE WHEN NOT cens OR c >= 8 THEN CAST(least(c, 8) AS INTEGER) END AS prior_count, CASE WHEN cens THEN false ELSE c = 0 END AS debut FROM o""")
def prior_count(spark, sf):
    return asof.ordinal(episodes(spark, sf), "entity", ["day"], "day", 8, "2024-01-01").select("entity", "day", "prior_count", "debut")


@query("prior_mean_std", f"""WITH {EPISODES} SELECT entity, day, round(avg(v) OVER w, 6) AS prior_mean, round(CASE WHEN count(v) OVER w > 1 THEN stddev_samp(v) OVER w END, 5) AS prior_std
  FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_mean_std(spark, sf):
    return asof.prior_mean_std(episodes(spark, sf), ["entity"], ["day"], "v").select("entity", "day", r("prior_mean"), r("prior_std", 5))


@query("rolling_prior_n", f"""WITH {EPISODES} SELECT entity, day, round(CASE WHEN count(v) OVER w5 >= 2 THEN avg(v) OVER w5 END, 6) AS mean5,
    round(CASE WHEN count(v) OVER w8 >= 4 THEN sum(v) OVER w8 END, 6) AS sum8, round(CASE WHEN count(v) OVER w1 >= 1 THEN avg(v) OVER w1 END, 6) AS mean1
  FROM ep WINDOW w5 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    w8 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), w1 AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)""")
def rolling_prior_n(spark, sf):
    rows = episodes(spark, sf)
    for name, n, how in (("mean5", 5, "mean"), ("sum8", 8, "sum"), ("mean1", 1, "mean")):
        rows = asof.rolling_prior(rows, ["entity"], ["day"], "v", n, name, how)
    return rows.select("entity", "day", r("mean5"), r("sum8"), r("mean1"))


@query("offset_rolling", f"""WITH {EPISODES} SELECT entity, day, round(avg(v) OVER a - avg(v) OVER b, 6) AS delta FROM ep
  WINDOW a AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 10 PRECEDING AND 4 PRECEDING)""")
def offset_rolling(spark, sf):
    return asof.offset_rolling(episodes(spark, sf), ["entity"], ["day"], "v").select("entity", "day", r("delta"))


@query("calendar_window", f"""WITH {BULK_DAYS} SELECT entity, day, round(coalesce(sum(q) OVER a, 0), 4) AS q15, round(coalesce(sum(q) OVER b, 0), 4) AS q3
  FROM bd WINDOW a AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
    b AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def calendar_window(spark, sf):
    rows = bulk_days(spark, sf)
    rows = asof.calendar_window(rows, ["entity"], "day", "q", 15, "q15")
    return asof.calendar_window(rows, ["entity"], "day", "q", 3, "q3").select("entity", "day", r("q15", 4), r("q3", 4))


@query("calendar_window_same_day", f"""WITH {LOG} SELECT event_id, round(coalesce(sum(value) OVER a, 0) + coalesce(sum(value) OVER b, 0), 4) AS load
  FROM log WINDOW a AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
    b AS (PARTITION BY entity, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def calendar_window_same_day(spark, sf):
    return asof.calendar_window(log(spark, sf), ["entity"], "day", "value", 3, "load", ["ts", "event_id"]).select("event_id", r("load", 4))


@query("recent_vs_baseline", f"""WITH {LOG}, m AS (SELECT *, max(day) OVER (PARTITION BY entity) AS last FROM log)
  SELECT entity, round(avg(CASE WHEN last - day <= 10 THEN value END), 6) AS recent, round(avg(CASE WHEN last - day > 10 THEN value END), 6) AS baseline FROM m GROUP BY entity""")
def recent_vs_baseline(spark, sf):
    return asof.recent_vs_baseline(log(spark, sf), "entity", "day", "value", 10).select("entity", r("recent"), r("baseline"))


@query("recent_vs_baseline_bulk", f"""WITH {BULK_DAYS} SELECT entity, day, round(sum(q) OVER a / sum(n) OVER a, 6) AS recent, round(sum(q) OVER b / sum(n) OVER b, 6) AS baseline FROM bd
  WINDOW a AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
    b AS (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 31 DAY PRECEDING)""")
def recent_vs_baseline_bulk(spark, sf):
    return asof.recent_vs_baseline_bulk(bulk_days(spark, sf), ["entity"], "day", "q", "n").select("entity", "day", r("recent"), r("baseline"))


@query("lag_diff", f"""WITH {EPISODES} SELECT entity, day, CAST(day - lag(day) OVER w AS INTEGER) AS days_since_prior, lag(n) OVER w AS prior_place,
    CAST(coalesce(greatest(0, n - lag(n) OVER w), 0) AS BIGINT) AS shift FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day)""")
def lag_diff(spark, sf):
    rows = asof.lag_diff(episodes(spark, sf), ["entity"], ["day"], "day", "n")
    return rows.select("entity", "day", "days_since_prior", "prior_place", F.when(F.col("prior_place").isNull(), 0).otherwise(F.col("shift")).cast("long").alias("shift"))


@query("lead_diff_state", f"""WITH {LOG}, st AS (SELECT event_id, entity, day, ts, k % 4 AS cur FROM log),
  d AS (SELECT *, lead(cur) OVER (PARTITION BY entity, day ORDER BY ts, event_id) AS nxt FROM st)
  SELECT event_id, CAST(least(3, greatest(0, CASE WHEN nxt IS NULL THEN 3 - cur ELSE nxt - cur END)) AS INTEGER) AS gained FROM d""")
def lead_diff(spark, sf):
    rows = log(spark, sf).withColumn("cur", F.col("k") % 4)
    return epi.lead_diff(rows, ["entity", "day"], ["ts", "event_id"], "cur", total=3).select("event_id", "gained")


@query("lead_diff_walkoff", f"""WITH {LOG}, st AS (SELECT event_id, entity, day, ts, k % 4 AS cur, value, (kind = 'purchase') AS scored FROM log),
  d AS (SELECT *, lead(cur) OVER w AS nxt, max(event_id) OVER (PARTITION BY entity, day) AS last_id FROM st WINDOW w AS (PARTITION BY entity, day ORDER BY ts, event_id))
  SELECT event_id, CAST(CASE WHEN nxt IS NULL AND event_id = last_id AND value > 60 AND scored THEN 0
    ELSE least(3, greatest(0, CASE WHEN nxt IS NULL THEN 3 - cur ELSE nxt - cur END)) END AS INTEGER) AS gained FROM d""")
def lead_diff_walkoff(spark, sf):
    rows = log(spark, sf).withColumn("cur", F.col("k") % 4)
    rows = rows.withColumn("over", epi.walkoff(F.col("value") > 60, F.col("kind") == "purchase", needs_score=True) & (F.col("event_id") == F.max("event_id").over(Window.partitionBy("entity", "day"))))
    return epi.lead_diff(rows, ["entity", "day"], ["ts", "event_id"], "cur", total=3, ended="over").select("event_id", "gained")


@query("reattribute_across_change", f"""WITH {LOG}, g AS (SELECT event_id, day, ts, entity % 10 AS board, k % 3 AS actor, kind, CAST(k % 4 AS INTEGER) AS got FROM log),
  l AS (SELECT *, lead(actor) OVER w AS na FROM g WINDOW w AS (PARTITION BY board, day ORDER BY ts, event_id)),
  m AS (SELECT *, CASE WHEN na IS NOT NULL AND na <> actor AND got > 1 AND NOT regexp_matches(kind, 'error|signup') THEN got - 1 ELSE 0 END AS mv FROM l)
  SELECT event_id, CAST(got - mv + coalesce(lag(mv) OVER (PARTITION BY board, day ORDER BY ts, event_id), 0) AS INTEGER) AS settled FROM m""")
def reattribute(spark, sf):
    rows = log(spark, sf).select("event_id", "day", "ts", (F.col("entity") % 10).alias("board"), (F.col("k") % 3).alias("actor"), "kind", (F.col("k") % 4).alias("got"))
    return epi.reattribute(rows, ["board", "day"], ["ts", "event_id"], "actor", "got", 1, F.col("kind").rlike("error|signup")).select("event_id", F.col("settled").cast("int").alias("settled"))


@query("sequence_and_tto", f"""WITH {LOG}, q AS (SELECT event_id, row_number() OVER (PARTITION BY entity, epoch ORDER BY ts, event_id) AS seq FROM log)
  SELECT event_id, CAST(seq AS INTEGER) AS seq, CAST(CASE WHEN seq <= 9 THEN 1 WHEN seq <= 18 THEN 2 WHEN seq <= 27 THEN 3 ELSE 4 END AS INTEGER) AS bucket FROM q""")
def sequence(spark, sf):
    return epi.sequence_buckets(log(spark, sf), ["entity", "epoch"], ["ts", "event_id"]).select("event_id", "seq", "bucket")


@query("first_n_distinct", f"""WITH {LOG}, f AS (SELECT entity, epoch, k, min(ts) AS t FROM log GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY entity, epoch ORDER BY t, k) AS place FROM f) SELECT entity, epoch, k, CAST(place AS INTEGER) AS place FROM o WHERE place <= 9""")
def first_n_distinct(spark, sf):
    return epi.first_n_distinct(log(spark, sf), ["entity", "epoch"], "k", "ts", 9).select("entity", "epoch", "k", "place")


@query("starter_of_episode", f"""WITH {LOG} SELECT day, k % 2 AS side, arg_min(entity, event_id) AS starter FROM log GROUP BY ALL""")
def starter(spark, sf):
    return epi.starter(log(spark, sf).withColumn("side", F.col("k") % 2), ["day", "side"], "entity", "event_id")


@query("last_n_episodes", f"""WITH {EPISODES}, l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM ep)
  SELECT entity, round(sum(s) FILTER (rn <= 5) / sum(n) FILTER (rn <= 5)::DOUBLE, 6) AS rate5, round(sum(s) FILTER (rn <= 10) / sum(n) FILTER (rn <= 10)::DOUBLE, 6) AS rate10,
    round(sum(s) FILTER (rn <= 5) / sum(n) FILTER (rn <= 5)::DOUBLE - sum(s) FILTER (rn <= 10) / sum(n) FILTER (rn <= 10)::DOUBLE, 6) AS trend FROM l GROUP BY entity""")
def last_n(spark, sf):
    rows = episodes(spark, sf)
    five = asof.last_n_rate(rows, "entity", ["day"], "s", "n", 5).select("entity", F.col("rate").alias("rate5"))
    ten = asof.last_n_rate(rows, "entity", ["day"], "s", "n", 10).select("entity", F.col("rate").alias("rate10"))
    return five.join(ten, "entity").select("entity", r("rate5"), r("rate10"), F.round(F.col("rate5") - F.col("rate10"), 6).alias("trend"))


@query("entity_distribution", f"""WITH {EPISODES}, l AS (SELECT entity, n, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM ep WHERE n >= 2)
  SELECT entity, round(avg(n), 6) AS mean, round(stddev_pop(n), 5) AS sd, CAST(count(DISTINCT n) AS INTEGER) AS bins, round(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS p2 FROM l WHERE rn <= 10 GROUP BY entity""")
def entity_distribution(spark, sf):
    rows = asof.value_distribution(episodes(spark, sf), "entity", ["day"], "n", 10, 2)
    p2 = F.coalesce(F.try_element_at("pmf", F.lit(2).cast("long")), F.lit(0.0))
    return rows.select("entity", r("mean"), r("sd", 5), F.size("pmf").alias("bins"), F.round(p2, 6).alias("p2"))


@query("asof_distribution", f"""WITH {EPISODES}, sp AS (SELECT entity, day, least(n, 6) AS n, unnest(range(0, 7)) AS k FROM ep),
  own AS (SELECT entity, day, k, sum(CASE WHEN n = k THEN 1 ELSE 0 END) AS c, count(*) AS n FROM sp GROUP BY ALL),
  lg AS (SELECT day, k, sum(c) AS lc, sum(n) AS ln FROM own GROUP BY ALL),
  po AS (SELECT *, coalesce(sum(c) OVER w, 0) AS pc, coalesce(sum(n) OVER w, 0) AS pn FROM own WINDOW w AS (PARTITION BY entity, k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  pl AS (SELECT day, k, (coalesce(sum(lc) OVER w, 0) + 1) / (coalesce(sum(ln) OVER w, 0) + 7)::DOUBLE AS q FROM lg WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT entity, day, CAST(k AS INTEGER) AS k, round((pc + 20 * q) / (pn + 20), 6) AS p FROM po JOIN pl USING (day, k)""")
def asof_distribution(spark, sf):
    return asof.asof_distribution(episodes(spark, sf), "entity", "day", "n", 6).select("entity", "day", "k", r("p"))


@query("asof_point_filter", f"""WITH {EPISODES} SELECT entity, day, CAST(coalesce(sum(n) OVER (PARTITION BY entity, epoch ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - n AS BIGINT) AS prior_n,
    CAST(coalesce(sum(s) OVER (PARTITION BY entity, epoch ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - s AS BIGINT) AS prior_s FROM ep""")
def asof_point(spark, sf):
    return asof.asof_point(episodes(spark, sf), ["day"], "entity", "day", ["n", "s"], "epoch").select("entity", "day", "prior_n", "prior_s")


@query("asof_point_strict_day", f"""WITH {LOG}, e AS (SELECT entity, day, k % 3 AS game, count(*) AS n FROM log GROUP BY ALL)
  SELECT entity, day, game, CAST(coalesce(sum(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS strict_n,
    CAST(sum(n) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS loose_n FROM e""")
def asof_point_strict(spark, sf):
    games = log(spark, sf).groupBy("entity", "day", (F.col("k") % 3).alias("game")).agg(F.count(F.lit(1)).alias("n"))
    rows = asof.asof_point(games, ["game"], "entity", "day", ["n"], strict_day=True).withColumnRenamed("prior_n", "strict_n")
    return asof.asof_point(rows, ["game"], "entity", "day", ["n"]).select("entity", "day", "game", "strict_n", F.col("prior_n").alias("loose_n"))


@query("consecutive_run", f"""WITH {EPISODES}, f AS (SELECT *, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS home FROM ep), i AS (SELECT *, sum(home) OVER (PARTITION BY entity ORDER BY day) AS island FROM f)
  SELECT entity, day, CAST(sum(1 - home) OVER (PARTITION BY entity, island ORDER BY day) AS BIGINT) AS run FROM i""")
def consecutive_run(spark, sf):
    rows = episodes(spark, sf).withColumn("home", (F.col("n") >= 3).cast("int"))
    return epi.consecutive_run(rows, ["entity"], ["day"], "home").select("entity", "day", F.col("run").cast("long").alias("run"))


@query("doubleheader_flag", f"""WITH {LOG}, g AS (SELECT DISTINCT day, entity % 7 AS team_a, k % 7 AS team_b, min(event_id) OVER (PARTITION BY day, entity % 7, k % 7) AS game FROM log),
  t AS (SELECT day, game, team_a AS team FROM g UNION SELECT day, game, team_b FROM g)
  SELECT day, game, team, row_number() OVER (PARTITION BY team, day ORDER BY game) > 1 AS later FROM t""")
def doubleheader(spark, sf):
    g = log(spark, sf).groupBy("day", (F.col("entity") % 7).alias("team_a"), (F.col("k") % 7).cast("long").alias("team_b")).agg(F.min("event_id").alias("game"))
    return epi.later_same_day(g, "game", ["team_a", "team_b"], "day").select("day", "game", "team", "later")


for _rule, _bin in (
    ("round", "(SELECT count(*) FROM range(1, 10) t(i) WHERE round_even(i * nn / 10.0::DOUBLE, 0) <= rk)"),
    ("floor", "(SELECT count(*) FROM range(1, 10) t(i) WHERE floor(i * nn / 10) <= rk)"),
    ("chunk", "CAST(floor(rk / greatest(1, nn // 10)) AS BIGINT)"),
):
    @query(f"equal_count_bins_{_rule}", f"""WITH {EPISODES}, x AS (SELECT v, row_number() OVER (ORDER BY v, entity, day) - 1 AS rk, count(*) OVER () AS nn FROM ep)
      SELECT CAST({_bin} AS INTEGER) AS bin, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x GROUP BY 1""")
    def equal_bins(spark, sf, rule=_rule):
        rows = ranking.equal_count_bins(episodes(spark, sf), "v", ["entity", "day"], 10, rule)
        return rows.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


@query("equal_count_bins_quantile", f"""WITH {EPISODES}, q AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM ep)
  SELECT CAST(len(list_filter(e, lambda x: v > x)) AS INTEGER) AS bin, count(*) AS n FROM ep, q GROUP BY 1""")
def quantile_bins(spark, sf):
    # Many episodes have equal sums, and edges lie among them: sums are added in the order of the log.
    ep = A.sums_in_order(log(spark, sf), ["entity", "day"], ["event_id", "value"], {"v": F.col("value")})
    return ranking.equal_count_bins(ep, "v", ["entity", "day"], 10, "quantile").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("leave_one_out", f"""WITH {EPISODES} SELECT entity, day, CAST(sum(n) OVER (PARTITION BY entity) - n AS BIGINT) AS other_n, CAST(sum(s) OVER (PARTITION BY entity) - s AS BIGINT) AS other_s FROM ep""")
def leave_one_out(spark, sf):
    return asof.leave_one_out(episodes(spark, sf), "entity", ["n", "s"]).select("entity", "day", "other_n", "other_s")


@query("previous_epoch", f"""WITH {EPISODES}, t AS (SELECT entity, epoch, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM ep GROUP BY ALL)
  SELECT a.entity, a.epoch, a.n, a.s, b.n AS last_n, b.s AS last_s FROM t a LEFT JOIN t b ON a.entity = b.entity AND a.epoch = b.epoch + 1""")
def previous_epoch(spark, sf):
    return asof.previous_epoch(episodes(spark, sf), "entity", "epoch", ["n", "s"])


@query("global_stable_order", f"""WITH {LOG} SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS place FROM log""")
def global_order(spark, sf):
    return ranking.global_rank(log(spark, sf), "value", ["event_id"], "place").select("event_id", "place")
