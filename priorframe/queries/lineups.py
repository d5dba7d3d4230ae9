"""Queries of lineups, staff, habits and of the sinks that stages are kept in."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.functions.rates import gated_rate, safe_rate
from priorframe.operators import asof
from priorframe.plans import lineup as L
from priorframe.queries.aggregates import FLAGS, flagged
from priorframe.queries.base import BULK, BULK_DAYS, EPISODES, LOG, bulk, bulk_days, episodes, log, query, r
from priorframe.sources import files
from priorframe.sources.work import work_dir

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WEIGHTS = f"CAST([{', '.join(map(str, L.SLOT_WEIGHTS))}] AS DOUBLE[])"

SLOTS = f"""{LOG}{FLAGS}, st AS (SELECT day, k % 2 AS side, arg_min(entity, event_id) AS entity FROM log GROUP BY ALL),
  ln AS (SELECT * FROM (SELECT day, k % 2 AS side, k, row_number() OVER (PARTITION BY day, k % 2 ORDER BY min(event_id)) AS pos FROM log GROUP BY day, k) WHERE pos <= 9),
  bt AS (SELECT k, day, count(*) AS n, sum(success) AS s, count(*) FILTER (value > 50) AS o, count(*) FILTER (value > 50 AND swing = 1) AS os, sum(swing) AS sw, sum(whiff) AS wh, count(*) FILTER (entity % 4 = 0) AS nl, sum(success) FILTER (entity % 4 = 0) AS sl FROM f GROUP BY ALL),
  bp AS (SELECT k, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(o) OVER w, 0) AS o, coalesce(sum(os) OVER w, 0) AS os, coalesce(sum(sw) OVER w, 0) AS sw, coalesce(sum(wh) OVER w, 0) AS wh, coalesce(sum(nl) OVER w, 0) AS nl, coalesce(sum(coalesce(sl, 0)) OVER w, 0) AS sl FROM bt WINDOW w AS (PARTITION BY k ORDER BY day {PRIOR})),
  en AS (SELECT entity, day, count(*) AS n, sum(success) AS s, count(*) FILTER (k % 3 = 0) AS nl, coalesce(sum(success) FILTER (k % 3 = 0), 0) AS sl FROM log GROUP BY ALL),
  ep AS (SELECT entity, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(nl) OVER w, 0) AS nl, coalesce(sum(sl) OVER w, 0) AS sl FROM en WINDOW w AS (PARTITION BY entity ORDER BY day {PRIOR})),
  so AS (SELECT st.day, st.entity, st.side, CASE WHEN st.entity % 4 = 0 THEN 'L' ELSE 'R' END AS hand, ep.n AS pn, ep.s AS ps, ep.nl AS pnl, ep.sl AS psl FROM st JOIN ep USING (entity, day)),
  sl AS (SELECT so.day, so.entity, hand, ln.pos, bp.n AS trials, coalesce(CASE WHEN hand = 'L' AND bp.nl >= 10 THEN bp.sl / bp.nl::DOUBLE WHEN hand = 'R' AND bp.n - bp.nl >= 10 THEN (bp.s - bp.sl) / (bp.n - bp.nl)::DOUBLE END, CASE WHEN bp.n > 0 THEN bp.s / bp.n::DOUBLE END, 0.225::DOUBLE) AS rate, CASE WHEN pn > 0 THEN ps / pn::DOUBLE ELSE 0.225::DOUBLE END AS own,
    CASE WHEN bp.o >= 5 THEN bp.os / bp.o::DOUBLE END AS chase, CASE WHEN bp.sw >= 10 THEN (bp.sw - bp.wh) / bp.sw::DOUBLE END AS contact, CASE WHEN ln.k % 5 = 0 THEN CASE WHEN hand = 'L' THEN 'R' ELSE 'L' END WHEN ln.k % 3 = 0 THEN 'L' ELSE 'R' END AS stands, {WEIGHTS}[pos] AS w
    FROM so JOIN ln ON so.day = ln.day AND so.side <> ln.side JOIN bp ON bp.k = ln.k AND bp.day = ln.day),
  ag AS (SELECT day, entity, sum(rate * w) / sum(w) AS weighted_rate, sum(w * rate * own / (0.84::DOUBLE * rate * own + (0.225::DOUBLE - 0.84::DOUBLE * 0.225::DOUBLE * 0.225::DOUBLE))) / sum(w) AS matchup, avg(rate) AS mean_rate, avg(chase) AS chase, avg(contact) AS contact, count(*) FILTER (stands = 'L') AS n_left, count(*) FILTER (trials < 30) AS n_bench, count(*) FILTER (trials < 100) AS n_rookies, count(*) AS n_slots FROM sl GROUP BY ALL)"""


def starters(spark, sf):
    """day, side, entity, hand and the sums of strictly earlier days: n, s, and nl, sl against the left side."""
    e = log(spark, sf)
    left = F.col("k") % 3 == 0
    days = e.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("s"), F.sum(left.cast("long")).alias("nl"), F.sum(F.when(left, F.col("success")).otherwise(0)).alias("sl"))
    state = asof.prior_sums(days, ["entity"], ["day"], ["n", "s", "nl", "sl"], "own_").select("entity", "day", "own_n", "own_s", "own_nl", "own_sl")
    first = e.groupBy("day", (F.col("k") % 2).alias("side")).agg(F.min_by("entity", "event_id").alias("entity"))
    return first.join(state, ["entity", "day"]).withColumn("hand", F.when(F.col("entity") % 4 == 0, "L").otherwise("R"))


def lineups(spark, sf):
    """Slots of the lineups that starters face, with what was known of the members before the day."""
    e = flagged(spark, sf)
    far, left = F.col("value") > 50, F.col("entity") % 4 == 0
    days = e.groupBy("k", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("success").alias("s"), F.sum(far.cast("long")).alias("o"), F.sum((far & (F.col("swing") == 1)).cast("long")).alias("os"), F.sum("swing").alias("sw"), F.sum("whiff").alias("wh"),
        F.sum(left.cast("long")).alias("nl"), F.sum(F.when(left, F.col("success")).otherwise(0)).alias("sl"),
    )
    known = asof.prior_sums(days, ["k"], ["day"], ["n", "s", "o", "os", "sw", "wh", "nl", "sl"])
    slots = L.first_slots(e.withColumn("side", F.col("k") % 2), ["day", "side"], "k", "event_id").join(known, ["k", "day"]).withColumn("side", 1 - F.col("side"))
    rows = slots.join(starters(spark, sf), ["day", "side"])
    by_hand = F.when(F.col("hand") == "L", gated_rate("prior_sl", "prior_nl", 10)).otherwise(gated_rate(F.col("prior_s") - F.col("prior_sl"), F.col("prior_n") - F.col("prior_nl"), 10))
    bats = F.when(F.col("k") % 5 == 0, "S").when(F.col("k") % 3 == 0, "L").otherwise("R")
    return rows.select(
        "day", "entity", "hand", "pos", F.col("prior_n").alias("trials"), F.coalesce(by_hand, safe_rate("prior_s", "prior_n")).alias("rate"), safe_rate("own_s", "own_n").alias("own_rate"),
        gated_rate("prior_os", "prior_o", 5).alias("chase"), gated_rate(F.col("prior_sw") - F.col("prior_wh"), "prior_sw", 10).alias("contact"), L.effective_side(bats, "hand").alias("stands"),
    )


CORE = ("weighted_rate", "matchup", "mean_rate", "chase", "contact")


@query("lineup_aggregates", f"WITH {SLOTS} SELECT day, entity, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in CORE)}, n_left, n_bench, n_rookies, n_slots, round(n_left / n_slots::DOUBLE, 6) AS left_share, round(n_rookies / n_slots::DOUBLE, 6) AS rookie_share FROM ag")
def lineup_aggregates(spark, sf):
    x = L.lineup_aggregates(lineups(spark, sf), ["day", "entity"])
    return x.select("day", "entity", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in CORE), "n_left", "n_bench", "n_rookies", "n_slots", r("left_share"), r("rookie_share"))


@query("lineup_features", f"""WITH {SLOTS}, x AS (SELECT ag.*, CASE WHEN entity % 4 = 0 THEN 570 ELSE 1670 END AS wt, CASE WHEN pnl >= 20 THEN psl / pnl::DOUBLE END AS vl, CASE WHEN pn - pnl >= 20 THEN (ps - psl) / (pn - pnl)::DOUBLE END AS vr FROM ag JOIN so USING (day, entity))
  SELECT day, entity, round(matchup + 1e-9, 6) AS matchup, n_left, round(vl + 1e-9, 6) AS vs_left, round(vr + 1e-9, 6) AS vs_right, round(coalesce((vl * n_left * 30 + wt * 0.225::DOUBLE) / (n_left * 30 + wt), 0.225) + 1e-9, 6) AS vs_left_regressed, round(coalesce((vr * (n_slots - n_left) * 30 + wt * 0.225::DOUBLE) / ((n_slots - n_left) * 30 + wt), 0.225) + 1e-9, 6) AS vs_right_regressed FROM x""")
def lineup_features(spark, sf):
    s = starters(spark, sf).select("day", "entity", "hand", gated_rate("own_sl", "own_nl", 20).alias("vs_left"), gated_rate(F.col("own_s") - F.col("own_sl"), F.col("own_n") - F.col("own_nl"), 20).alias("vs_right"))
    x = L.lineup_aggregates(lineups(spark, sf), ["day", "entity"]).join(s, ["day", "entity"])
    x = x.withColumn("vs_left_regressed", L.platoon_regressed("vs_left", F.col("n_left") * L.REGULAR, "hand")).withColumn("vs_right_regressed", L.platoon_regressed("vs_right", (F.col("n_slots") - F.col("n_left")) * L.REGULAR, "hand"))
    return x.select("day", "entity", "n_left", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("matchup", "vs_left", "vs_right", "vs_left_regressed", "vs_right_regressed")))


@query("staff_features", f"""WITH {LOG}{FLAGS}, g AS (SELECT day, k % 2 AS side, arg_min(entity, event_id) AS entity, arg_max(k, event_id) AS catcher, arg_max(entity, event_id) % 8 AS umpire FROM log GROUP BY ALL),
  lg AS (SELECT day, sum(sum(called)) OVER w / nullif(sum(sum(taken)) OVER w, 0)::DOUBLE AS q FROM f GROUP BY day WINDOW w AS (ORDER BY day {PRIOR})),
  c AS (SELECT k AS id, day, sum(sum(taken)) OVER w AS t, sum(sum(called)) OVER w AS h FROM f GROUP BY k, day WINDOW w AS (PARTITION BY k ORDER BY day {PRIOR})),
  u AS (SELECT entity % 8 AS id, day, sum(sum(taken)) OVER w AS t, sum(sum(called)) OVER w AS h FROM f GROUP BY entity % 8, day WINDOW w AS (PARTITION BY entity % 8 ORDER BY day {PRIOR}))
  SELECT g.day, g.entity, round(CASE WHEN c.t >= 10 THEN c.h / c.t::DOUBLE END - q + 1e-9, 6) AS catcher_called, round(CASE WHEN u.t >= 50 THEN u.h / u.t::DOUBLE END - q + 1e-9, 6) AS umpire_called, side = 0 AS is_home
  FROM g JOIN lg USING (day) LEFT JOIN c ON c.id = catcher AND c.day = g.day LEFT JOIN u ON u.id = umpire AND u.day = g.day""")
def staff_features(spark, sf):
    e = flagged(spark, sf).withColumn("umpire", F.col("entity") % 8)
    days = lambda key: e.groupBy(key, "day").agg(F.sum("taken").alias("taken"), F.sum("called").alias("called"))
    games = e.groupBy("day", (F.col("k") % 2).alias("side")).agg(F.min_by("entity", "event_id").alias("entity"), F.max_by("k", "event_id").alias("k"), F.max_by("umpire", "event_id").alias("umpire"))
    x = games.join(L.over_league(days("k"), "k", "day", "taken", "called", 10, "catcher_called"), ["k", "day"], "left").join(L.over_league(days("umpire"), "umpire", "day", "taken", "called", 50, "umpire_called"), ["umpire", "day"], "left")
    return x.select("day", "entity", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("catcher_called", "umpire_called")), (F.col("side") == 0).alias("is_home"))


@query("slot_stats", f"WITH {BULK}, c AS (SELECT slot, entity, count(*) AS n, sum(success) AS h FROM bulk GROUP BY ALL) SELECT slot, CAST(sum(n) AS BIGINT) AS n, round(sum(h) / sum(n)::DOUBLE, 6) AS rate, round(stddev_samp(h / n::DOUBLE), 6) AS spread, count(*) AS entities FROM c GROUP BY slot")
def slot_stats(spark, sf):
    return L.slot_stats(bulk(spark, sf), "entity", "slot", "success").select("slot", "n", r("rate"), r("spread"), "entities")


# --- sinks, read back ------------------------------------------------------------------------------


@query("feature_stage", f"""WITH {BULK_DAYS} SELECT entity, day, epoch, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS prior_s FROM bd WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR})""")
def feature_stage(spark, sf):
    """A stage of features kept as a table by epoch, and read by whoever assembles."""
    path = work_dir(spark, "stage")
    files.sink_partitions(asof.prior_sums(bulk_days(spark, sf), ["entity", "epoch"], ["day"], ["n", "s"]).select("entity", "day", "prior_n", "prior_s", "epoch"), path, ["epoch"])
    return spark.read.parquet(path).select("entity", "day", F.col("epoch").cast("int").alias("epoch"), "prior_n", "prior_s")


@query("sink_parquet", f"WITH {EPISODES} SELECT entity, day, n + CASE WHEN epoch = 2 THEN 100 ELSE 0 END AS n, epoch FROM ep")
def sink_parquet(spark, sf):
    """The table by epoch, then one epoch replaced; the others stay."""
    path, ep = work_dir(spark, "starts"), episodes(spark, sf).select("entity", "day", "n", "epoch")
    files.sink_partitions(ep, path, ["epoch"])
    files.sink_partitions(ep.filter("epoch = 2").withColumn("n", F.col("n") + 100), path, ["epoch"])
    return spark.read.parquet(path).select("entity", "day", "n", F.col("epoch").cast("int").alias("epoch"))


@query("append_capture", f"WITH {LOG} SELECT event_id, CASE WHEN k % 2 = 0 THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 HOUR * (k // 50) END AS captured_at FROM log")
def append_capture(spark, sf):
    """Two captures, each with its stamp, appended to one table."""
    path, e = work_dir(spark, "captures"), log(spark, sf).select("event_id", "k", F.when(F.col("k") % 2 == 0, F.col("ts").cast("timestamp")).alias("captured_at"))
    files.append_capture(e.filter("k < 50"), "2024-02-01 00:00:00", path)
    files.append_capture(e.filter("k >= 50"), "2024-02-01 01:00:00", path)
    return spark.read.parquet(path).select("event_id", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query("scan_quote_csv", f"WITH {LOG} SELECT event_id, entity, k + 100 AS over_odds, -110 - k AS under_odds FROM log WHERE kind = 'view'")
def scan_quote_csv(spark, sf):
    """Quotes written as CSV captures and scanned with their schema."""
    path = work_dir(spark, "quotes")
    rows = log(spark, sf).filter("kind = 'view'").select("event_id", "entity", (F.col("k") + 100).alias("over_odds"), (-110 - F.col("k")).alias("under_odds"))
    rows.write.option("header", True).csv(path)
    return files.scan_csv_captures(spark, f"{path}/*.csv", rows.schema).select("event_id", "entity", "over_odds", "under_odds")
