"""Queries of prices, quotes, positions and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions import prices as P
from priorframe.operators import ledger as L, market as M
from priorframe.queries.base import BETS, LOG, bets, log, query, r

DEC = "CASE WHEN {0} > 0 THEN 1 + {0} / 100.0::DOUBLE WHEN {0} < 0 THEN 1 + 100.0::DOUBLE / -{0} END"
D1, D2 = DEC.format("odds"), DEC.format("other_odds")
GAIN = f"CASE grade WHEN 'WIN' THEN stake * ({D1} - 1) WHEN 'LOSS' THEN -stake ELSE 0.0::DOUBLE END"


def settled(spark, sf):
    return bets(spark, sf).withColumn("gain", P.profit("grade", "stake", "odds"))


@query("american_to_implied", f"WITH {BETS} SELECT bet, round({D1}, 6) AS decimal, round(1 / ({D1}), 6) AS implied FROM bets")
def american(spark, sf):
    return bets(spark, sf).select("bet", F.round(P.decimal_odds("odds"), 6).alias("decimal"), F.round(P.implied("odds"), 6).alias("implied"))


@query("american_parse", r"""SELECT o_orderkey, TRY_CAST(replace(CASE WHEN o_orderkey % 3 = 0 THEN '−' || CAST(100 + o_orderkey % 50 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN ' +120' ELSE 'x' END, '−', '-') AS INTEGER) AS odds FROM orders""")
def american_parse(spark, sf):
    from priorframe.queries.base import read

    o = read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("−"), (100 + F.col("o_orderkey") % 50).cast("string"))).when(F.col("o_orderkey") % 3 == 1, " +120").otherwise("x")
    return o.select("o_orderkey", P.parse_american(text).alias("odds"))


@query("no_vig", f"WITH {BETS} SELECT bet, round((1 / ({D1})) / (1 / ({D1}) + 1 / ({D2})), 6) AS fair, round(1 / ({D1}) + 1 / ({D2}) - 1, 6) AS hold FROM bets")
def no_vig(spark, sf):
    fair, hold = P.no_vig("odds", "other_odds")
    return bets(spark, sf).select("bet", F.round(fair, 6).alias("fair"), F.round(hold, 6).alias("hold"))


EDGE = f"""{BETS}, f AS (SELECT *, 1 / ({D1}) AS io, 1 / ({D2}) AS iu FROM bets), g AS (SELECT *, io / (io + iu) AS fair, io + iu - 1 AS hold, (bet % 4 <> 0) AS conf FROM f),
  h AS (SELECT *, 0.5 * (prob - fair) AS gain, 0.5 * prob + 0.5 * fair AS bl FROM g),
  i AS (SELECT *, CASE WHEN gain >= -gain THEN 'OVER' ELSE 'UNDER' END AS best_side, abs(bl - fair) AS edge, CASE WHEN gain >= -gain THEN odds ELSE other_odds END AS bo,
        CASE WHEN gain >= -gain THEN bl ELSE 1 - bl END AS bp, greatest(hold + 0.02, 0.03) + CASE WHEN conf THEN 0 ELSE 0.05 END AS threshold FROM h),
  j AS (SELECT *, CASE WHEN bo > 0 THEN 1 + bo / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / -bo END AS dec FROM i),
  e AS (SELECT *, bp * dec - 1 AS ev FROM j),
  k AS (SELECT *, CASE WHEN edge - threshold >= 0.06 THEN 'STRONG' WHEN edge - threshold >= 0.03 THEN 'MEDIUM' WHEN edge - threshold >= 0 THEN 'LEAN' ELSE 'NO_PLAY' END AS str,
        (edge >= threshold AND ev >= 0.04) AS play, greatest(0, least(2, 25 * ((dec - 1) * bp - (1 - bp)) / (dec - 1))) AS raw FROM e),
  q AS (SELECT *, CASE WHEN NOT play OR raw < 0.125 THEN 0 WHEN raw < 0.375 THEN 0.25 WHEN raw < 0.75 THEN 0.5 ELSE least(round_even(raw, 0), 2) END::DOUBLE AS units FROM k)"""


def step_down(x: str) -> str:
    """The greatest clean stake that is not above x."""
    return f"CASE {' '.join(f'WHEN {x} >= {d} - 1e-9 THEN {d}' for d in P.DENOMINATIONS)} ELSE 0 END::DOUBLE"


def cap_sql(bets: str, kind: str) -> str:
    """CTEs that end in capped (day, bet, units, capped): the fold over a day's bets of the CTE bets (day, bet, episode, stake, edge)."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY -edge, bet) AS rn FROM {bets} WHERE stake > 0),
  fold AS (SELECT DISTINCT day, CAST(0 AS BIGINT) AS rn, CAST(NULL AS {kind}) AS bet, {M.DAILY_CAP}::DOUBLE AS rest, CAST([] AS {kind}[]) AS seen, 0.0::DOUBLE AS units FROM ordered
    UNION ALL SELECT day, rn, bet, rest - given, CASE WHEN given > 0 THEN list_append(seen, episode) ELSE seen END, given
    FROM (SELECT *, CASE WHEN rest > 0 THEN {step_down('least(asked, rest)')} ELSE 0 END AS given FROM (SELECT o.day, o.rn, o.bet, o.episode, rest, seen, CASE WHEN list_contains(seen, o.episode) THEN o.stake * (1 - {M.REPEAT_HAIRCUT}::DOUBLE) ELSE o.stake END AS asked FROM fold JOIN ordered AS o ON o.day = fold.day AND o.rn = fold.rn + 1))),
  capped AS (SELECT day, bet, units, units <= 0 AS capped FROM fold WHERE rn > 0)"""


def edges(spark, sf):
    return M.evaluate_edges(bets(spark, sf), "prob", "odds", "other_odds", 0.5, F.col("bet") % 4 != 0)


@query("edge_and_strength", f"WITH {EDGE} SELECT bet, best_side, round(edge, 6) AS edge, round(threshold, 6) AS threshold, round(ev, 6) AS ev, str AS strength, play FROM q")
def edge_and_strength(spark, sf):
    return edges(spark, sf).select("bet", "best_side", r("edge"), r("threshold"), r("ev"), "strength", "play")


@query("kelly_stake", f"WITH {EDGE} SELECT bet, round(raw, 6) AS raw, units FROM q")
def kelly(spark, sf):
    return edges(spark, sf).select("bet", F.round(P.kelly_stake("best_prob", "best_odds"), 6).alias("raw"), F.col("stake").alias("units"))


@query("quantize_down", f"WITH {BETS} SELECT bet, CASE WHEN x >= 2 - 1e-9 THEN 2 WHEN x >= 1.5 - 1e-9 THEN 1.5 WHEN x >= 1 - 1e-9 THEN 1 WHEN x >= 0.5 - 1e-9 THEN 0.5 WHEN x >= 0.25 - 1e-9 THEN 0.25 ELSE 0 END::DOUBLE AS units FROM (SELECT bet, price / 150000 AS x FROM bets)")
def quantize_down(spark, sf):
    return bets(spark, sf).select("bet", P.quantize_down(F.col("price") / 150000).alias("units"))


@query("grade_and_pnl", f"WITH {BETS} SELECT bet, grade, round({GAIN}, 4) AS gain FROM bets")
def grade_and_pnl(spark, sf):
    return settled(spark, sf).select("bet", "grade", r("gain", 4))


@query("grade_pick", f"""WITH {LOG} SELECT event_id, CASE WHEN k % 10 = 9 THEN NULL WHEN k = 40 THEN 'PUSH' WHEN (k > 40) = (kind = 'view') THEN 'WIN' ELSE 'LOSS' END AS grade,
  CASE WHEN k % 10 = 9 THEN NULL WHEN k >= 60 THEN 'WIN' ELSE 'LOSS' END AS milestone FROM log""")
def grade_pick(spark, sf):
    actual = F.when(F.col("k") % 10 != 9, F.col("k"))
    side = F.when(F.col("kind") == "view", "over").otherwise("under")
    return log(spark, sf).withColumn("actual", actual).select("event_id", P.grade_line("actual", 40, side).alias("grade"), P.grade_milestone("actual", 60).alias("milestone"))


@query("clv", f"WITH {BETS} SELECT bet, round(1 / ({D2}) - 1 / ({D1}), 6) AS clv_prob, round(100 * (({D1}) / ({D2}) - 1), 5) AS clv_price FROM bets")
def clv(spark, sf):
    rows = bets(spark, sf).withColumn("a", P.implied("odds")).withColumn("b", P.implied("other_odds"))
    return rows.select("bet", F.round(P.clv_probability("a", "b"), 6).alias("clv_prob"), F.round(P.clv_price("odds", "other_odds"), 5).alias("clv_price"))


@query("performance_splits", f"""WITH {BETS}, s AS (SELECT *, {GAIN} AS gain FROM bets), a AS (SELECT 'strength' AS split, strength AS level, * EXCLUDE (strength) FROM s UNION ALL BY NAME SELECT 'odds' AS split, CAST(odds AS VARCHAR) AS level, * EXCLUDE (strength) FROM s
  UNION ALL BY NAME SELECT 'all' AS split, 'all' AS level, * EXCLUDE (strength) FROM s)
  SELECT split, level, count(*) AS n, CAST(count(*) FILTER (grade = 'WIN') AS BIGINT) AS wins, CAST(count(*) FILTER (grade = 'LOSS') AS BIGINT) AS losses, round(sum(gain), 3) AS gain,
    round(count(*) FILTER (grade = 'WIN') / count(*) FILTER (grade IN ('WIN', 'LOSS'))::DOUBLE, 6) AS hit_rate, round(sum(gain) / sum(stake), 6) AS roi FROM a GROUP BY ALL""")
def splits(spark, sf):
    return M.performance_splits(settled(spark, sf), ["strength", "odds"]).select("split", "level", "n", "wins", "losses", r("gain", 3), r("hit_rate"), r("roi"))


@query("record_summary", f"""WITH {BETS}, s AS (SELECT *, {GAIN} AS gain, CASE WHEN bet % 97 = 0 THEN {GAIN} + 0.5 ELSE {GAIN} END AS stored FROM bets)
  SELECT grade, count(*) AS n, round(sum(gain), 3) AS total, CAST(count(*) FILTER (abs(stored - gain) > 0.001) AS BIGINT) AS drifted FROM s GROUP BY grade""")
def record_summary(spark, sf):
    rows = settled(spark, sf).withColumn("stored", F.when(F.col("bet") % 97 == 0, F.col("gain") + 0.5).otherwise(F.col("gain")))
    return rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gain"), 3).alias("total"), F.count_if(F.abs(F.col("stored") - F.col("gain")) > 0.001).alias("drifted"))


@query("cumulative_pnl", f"""WITH {BETS}, d AS (SELECT strength, day, sum({GAIN}) AS g FROM bets GROUP BY ALL)
  SELECT strength, day, round(sum(g) OVER (PARTITION BY strength ORDER BY day), 3) AS total FROM d""")
def cumulative(spark, sf):
    days = settled(spark, sf).groupBy("strength", "day").agg(F.sum("gain").alias("g"))
    return days.select("strength", "day", F.round(F.sum("g").over(Window.partitionBy("strength").orderBy("day")), 3).alias("total"))


@query("equity_curve", f"""WITH {BETS}, d AS (SELECT strength, day, sum({GAIN}) AS g FROM bets GROUP BY ALL),
  e AS (SELECT *, sum(g) OVER w AS flat, max(CASE WHEN 1 + g / 100 <= 0 THEN 1 ELSE 0 END) OVER w AS ruin, 100 * exp(sum(CASE WHEN 1 + g / 100 > 0 THEN ln(greatest(1 + g / 100, 1e-300)) ELSE 0 END) OVER w) AS b FROM d WINDOW w AS (PARTITION BY strength ORDER BY day)),
  f AS (SELECT *, CASE WHEN ruin > 0 THEN 0 ELSE b END AS bank FROM e), h AS (SELECT *, greatest(100, max(bank) OVER (PARTITION BY strength ORDER BY day)) AS peak FROM f)
  SELECT strength, day, round(flat, 3) AS flat, ruin > 0 AS ruined, CASE WHEN bank < 1e9 THEN round(bank, 3) END AS bank, CASE WHEN bank < 1e9 THEN round(1 - bank / peak + 1e-7, 5) END AS drawdown FROM h""")
def equity(spark, sf):
    days = settled(spark, sf).groupBy("strength", "day").agg(F.sum("gain").alias("g"))
    rows = M.equity_curve(days, ["strength"], "day", "g")
    small = F.col("bank") < 1e9
    return rows.select("strength", "day", r("flat", 3), "ruined", F.when(small, F.round("bank", 3)).alias("bank"), F.when(small, F.round(F.col("drawdown") + 1e-7, 5)).alias("drawdown"))


@query("kelly_sweep", f"""WITH {BETS}, s AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS scale), d AS (SELECT scale, day, sum(scale * ({GAIN})) / 50 AS g FROM bets, s GROUP BY ALL),
  e AS (SELECT *, sum(ln(greatest(1 + g / 100, 1e-300))) OVER w AS lg, max(CASE WHEN 1 + g / 100 <= 0 THEN 1 ELSE 0 END) OVER w AS ruin, sum(g) OVER w AS flat FROM d WINDOW w AS (PARTITION BY scale ORDER BY day))
  SELECT scale, count(*) AS days, round(arg_max(flat, day), 3) AS flat, max(ruin) > 0 AS ruined FROM e GROUP BY scale""")
def kelly_sweep(spark, sf):
    scales = F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 2.0)))).alias("scale")
    days = settled(spark, sf).select("day", "gain", scales).groupBy("scale", "day").agg((F.sum(F.col("scale") * F.col("gain")) / 50).alias("g"))
    rows = M.equity_curve(days, ["scale"], "day", "g")
    return rows.groupBy("scale").agg(F.count(F.lit(1)).alias("days"), F.round(F.max_by("flat", "day"), 3).alias("flat"), F.max("ruined").alias("ruined"))


@query("last_capture", f"WITH {LOG} SELECT entity, kind, max(ts) AS ts, round(arg_max(value, ts), 6) AS value FROM log GROUP BY ALL")
def last_capture(spark, sf):
    return M.last_capture(log(spark, sf), ["entity", "kind"], "ts", "event_id").select("entity", "kind", "ts", r("value"))


@query("closing_capture", f"""WITH {LOG}, q AS (SELECT *, ts <= day + INTERVAL 15 HOUR AS pre, row_number() OVER (PARTITION BY entity, kind, day ORDER BY ts <= day + INTERVAL 15 HOUR DESC, ts DESC, event_id DESC) AS rn FROM log)
  SELECT entity, kind, day, round(value, 6) AS value, pre AS pregame FROM q WHERE rn = 1""")
def closing(spark, sf):
    q = log(spark, sf).withColumn("start", F.col("day").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
    return M.closing_capture(q, ["entity", "kind", "day"], "ts", "start", "event_id").select("entity", "kind", "day", r("value"), "pregame")


@query("line_movement", f"WITH {LOG} SELECT entity, kind, round(arg_min(value, ts), 6) AS open, round(arg_max(value, ts), 6) AS close, count(*) AS captures, round(arg_max(value, ts) - arg_min(value, ts), 6) AS move FROM log GROUP BY ALL")
def movement(spark, sf):
    return M.line_movement(log(spark, sf), ["entity", "kind"], "ts", "value").select("entity", "kind", r("open"), r("close"), "captures", r("move"))


@query("line_movement_windows", f"WITH {LOG} SELECT kind, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, round(arg_min(value, ts), 6) AS open, round(arg_max(value, ts), 6) AS close, count(*) AS captures FROM log GROUP BY ALL")
def movement_windows(spark, sf):
    w = log(spark, sf).groupBy("kind", F.window("ts", "6 hours").alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("captures"))
    return w.select("kind", F.col("w.start").alias("start"), r("open"), r("close"), "captures")


@query("snapshot_staleness", f"WITH {LOG} SELECT event_id, round(epoch_us(TIMESTAMP '2024-01-20 12:00:00') / 3600000000.0::DOUBLE - epoch_us(ts) / 3600000000.0::DOUBLE, 4) AS age FROM log WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-20 06:00:00' AND value IS NOT NULL")
def staleness(spark, sf):
    return M.fresh_quotes(log(spark, sf), "ts", "2024-01-20 12:00:00", 6, ["value"]).select("event_id", F.round("snapshot_age_hours", 4).alias("age"))


@query("devig_ladder", f"""WITH {LOG}, lad AS (SELECT entity, k AS milestone, min(value) AS v FROM log GROUP BY ALL), o AS (SELECT entity, milestone, CAST(CASE WHEN v < 40 THEN -100 - floor(v) ELSE 100 + floor(v) END AS INTEGER) AS odds FROM lad),
  h AS (SELECT entity, 0.01 * (entity % 9)::DOUBLE AS hold FROM log WHERE entity % 10 <> 3 GROUP BY ALL), raw AS (SELECT entity, milestone, 1 / ({D1}) / (1 + hold) AS raw FROM o JOIN h USING (entity))
  SELECT entity, milestone, round(min(raw) OVER (PARTITION BY entity ORDER BY milestone ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS fair FROM raw""")
def devig(spark, sf):
    e = log(spark, sf)
    lad = e.groupBy("entity", F.col("k").alias("milestone")).agg(F.min("value").alias("v"))
    lad = lad.withColumn("odds", F.when(F.col("v") < 40, -100 - F.floor("v")).otherwise(100 + F.floor("v")).cast("int"))
    holds = e.filter("entity % 10 <> 3").select("entity", (F.lit(0.01) * (F.col("entity") % 9)).alias("hold")).distinct()
    return M.devig_ladder(lad, holds, "entity", "milestone", "odds").select("entity", "milestone", r("fair"))


@query("evaluate_ladder", f"""WITH {LOG}, r AS (SELECT entity, k % 12 + 1 AS milestone, min(value) AS v, avg(success) AS rate FROM log GROUP BY ALL),
  x AS (SELECT entity, milestone, CASE WHEN v < 10 THEN -130 ELSE 100 + CAST(floor(v) AS INTEGER) END AS odds, 0.9::DOUBLE - 0.06::DOUBLE * milestone + 0.1::DOUBLE * rate AS model, entity % 5 + 2.5::DOUBLE AS line, entity % 3 <> 0 AS is_over, CASE WHEN entity % 4 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS units, entity % 4 AS gap FROM r),
  y AS (SELECT *, CAST(ceil(line) AS INTEGER) AS base, is_over AND gap >= {M.GAP_MIN} AS is_open, CASE WHEN odds > 0 THEN 1 + odds / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / -odds END AS dec FROM x),
  z AS (SELECT *, 1 / dec / (1 + {P.ALT_SIDE_MARGIN}::DOUBLE) AS fair, milestone - base AS far FROM y), b AS (SELECT *, 0.5 * model + 0.5 * fair AS blended FROM z), e AS (SELECT *, blended - fair AS edge, blended * dec - 1 AS ev FROM b),
  w AS (SELECT *, CASE WHEN edge > 0 THEN greatest(0, least(2, 25 * ((dec - 1) * blended - (1 - blended)) / (dec - 1))) ELSE 0 END AS raw, edge - {M.LADDER_THRESHOLD}::DOUBLE AS over_by FROM e),
  st AS (SELECT *, CASE WHEN over_by >= 0.06 THEN 'STRONG' WHEN over_by >= 0.03 THEN 'MEDIUM' WHEN over_by >= 0 THEN 'LEAN' ELSE 'NO_PLAY' END AS strength, CASE WHEN milestone = base THEN 'primary_equivalent' WHEN NOT is_open THEN 'passed_gap_gate' WHEN far NOT BETWEEN 1 AND {M.RUNGS} THEN 'passed_not_next_rung' WHEN edge <= 0 THEN 'passed_no_edge' WHEN ev < {P.MIN_EV} THEN 'passed_below_ev' WHEN raw < 0.1 THEN 'passed_stake_too_small' WHEN over_by < 0 THEN 'passed_below_threshold' ELSE 'candidate' END AS status FROM w),
  c AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY milestone) AS rn, least(raw, {P.KELLY_CAP}, units * pow({M.RUNG_FRACTION}, greatest(1, far))) AS most, {M.ENTITY_CAP}::DOUBLE - units AS room FROM st WHERE status = 'candidate'),
  one AS (SELECT *, CASE WHEN room > 0 THEN {step_down('least(most, room)')} ELSE 0 END AS stake FROM c WHERE rn = 1),
  both_ AS (SELECT entity, milestone, edge, ev, strength, room, stake FROM one UNION ALL SELECT c.entity, c.milestone, c.edge, c.ev, c.strength, c.room - one.stake, CASE WHEN c.room - one.stake > 0 THEN {step_down('least(c.most, c.room - one.stake)')} ELSE 0 END FROM c JOIN one ON one.entity = c.entity AND c.rn = 2)
  SELECT entity, milestone, CASE WHEN room <= 0 THEN 'passed_pitcher_cap' WHEN stake <= 0 THEN 'passed_stake_too_small' ELSE 'bet' END AS status, stake AS units, round(edge, 6) AS edge, round(ev, 6) AS ev, strength FROM both_
  UNION ALL SELECT entity, milestone, status, 0.0::DOUBLE, round(edge, 6), round(ev, 6), strength FROM st WHERE status <> 'candidate'""")
def ladder(spark, sf):
    e = log(spark, sf)
    rungs = e.groupBy("entity", (F.col("k") % 12 + 1).alias("milestone")).agg(F.min("value").alias("v"), F.avg("success").alias("rate"))
    rungs = rungs.select("entity", "milestone", F.when(F.col("v") < 10, -130).otherwise(100 + F.floor("v")).cast("int").alias("odds"), (F.lit(0.9) - 0.06 * F.col("milestone") + 0.1 * F.col("rate")).alias("model"))
    rungs = rungs.withColumn("line", F.col("entity") % 5 + 2.5).withColumn("side", F.when(F.col("entity") % 3 == 0, "UNDER").otherwise("OVER")).withColumn("units", F.when(F.col("entity") % 4 == 0, 2.0).otherwise(1.0)).withColumn("expected", F.col("line") + F.col("entity") % 4)
    out = M.evaluate_ladder(rungs, "entity", {k: k for k in ("line", "side", "units", "expected", "milestone", "odds", "model")})
    return out.select("entity", "milestone", "status", "units", r("edge"), r("ev"), "strength")


@query("portfolio_cap", f"WITH RECURSIVE {EDGE}, given_bets AS (SELECT day, bet, entity % 7 AS episode, units AS stake, edge FROM q), {cap_sql('given_bets', 'BIGINT')} SELECT day, bet, units, capped FROM capped")
def cap(spark, sf):
    rows = edges(spark, sf).withColumn("episode", F.col("entity") % 7)
    return M.portfolio_cap(rows, "day", "bet", "episode", "stake", "edge")


@query("trust_sweep", f"""WITH {BETS}, w AS (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS weight), f AS (SELECT *, 1 / ({D1}) AS io, 1 / ({D2}) AS iu FROM bets, w),
  g AS (SELECT *, io / (io + iu) AS fair, greatest(io + iu - 1 + 0.02, 0.03) AS threshold FROM f), h AS (SELECT *, weight * (prob - fair) AS edge, weight * prob + (1 - weight) * fair AS bl FROM g),
  p AS (SELECT * FROM h WHERE edge >= threshold AND bl * ({D1}) - 1 >= 0.04)
  SELECT weight, count(*) AS n, round(avg(CASE grade WHEN 'WIN' THEN ({D1}) - 1 WHEN 'LOSS' THEN -1 ELSE 0 END), 6) AS roi, round(avg(100 * (({D1}) / ({D2}) - 1)), 4) AS clv, count(*) >= 100 AND avg(100 * (({D1}) / ({D2}) - 1)) > 0 AS ready FROM p GROUP BY weight""")
def trust_sweep(spark, sf):
    rows = bets(spark, sf).withColumn("weight", F.explode(F.array(*(F.lit(x) for x in (0.25, 0.5, 1.0)))))
    fair, hold = P.no_vig("odds", "other_odds")
    rows = rows.withColumn("fair", fair).withColumn("threshold", P.edge_threshold(hold)).withColumn("edge", F.col("weight") * (F.col("prob") - F.col("fair")))
    bl = F.col("weight") * F.col("prob") + (1 - F.col("weight")) * F.col("fair")
    plays = rows.filter((F.col("edge") >= F.col("threshold")) & (P.expected_value(bl, "odds") >= P.MIN_EV))
    clv = P.clv_price("odds", "other_odds")
    return plays.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(P.profit("grade", 1, "odds")), 6).alias("roi"), F.round(F.avg(clv), 4).alias("clv"), ((F.count(F.lit(1)) >= 100) & (F.avg(clv) > 0)).alias("ready"))


UPSERT = f"""{BETS}, o AS (SELECT bet, CASE WHEN bet % 3 = 0 THEN grade END AS graded, day AS updated, CASE WHEN bet % 5 = 0 THEN NULL ELSE strength END AS note FROM bets WHERE bet % 4 <> 1),
  n AS (SELECT bet, CASE WHEN bet % 6 = 0 THEN grade END AS graded, day + CAST(bet % 3 - 1 AS INTEGER) AS updated, strength AS note FROM bets WHERE bet % 4 <> 2)"""


def versions(spark, sf):
    b = bets(spark, sf)
    old = b.filter("bet % 4 <> 1").select("bet", F.when(F.col("bet") % 3 == 0, F.col("grade")).alias("graded"), F.col("day").alias("updated"), F.when(F.col("bet") % 5 != 0, F.col("strength")).alias("note"))
    new = b.filter("bet % 4 <> 2").select("bet", F.when(F.col("bet") % 6 == 0, F.col("grade")).alias("graded"), F.date_add("day", (F.col("bet") % 3 - 1).cast("int")).alias("updated"), F.col("strength").alias("note"))
    return old, new


@query("ledger_upsert", f"""WITH {UPSERT}, u AS (SELECT *, 0 AS side FROM o UNION ALL SELECT *, 1 FROM n),
  rk AS (SELECT *, row_number() OVER (PARTITION BY bet ORDER BY graded IS NOT NULL DESC, updated DESC NULLS LAST, (graded IS NOT NULL)::INT + (updated IS NOT NULL)::INT + (note IS NOT NULL)::INT DESC, side) AS rn FROM u)
  SELECT bet, graded, updated, note FROM rk WHERE rn = 1""")
def upsert(spark, sf):
    return L.ledger_upsert(*versions(spark, sf), ["bet"], "graded", "updated").select("bet", "graded", "updated", "note")


@query("evidence_upsert", f"WITH {UPSERT} SELECT * FROM o WHERE bet NOT IN (SELECT bet FROM n) UNION ALL SELECT * FROM n")
def evidence(spark, sf):
    return L.evidence_upsert(*versions(spark, sf), ["bet"])


@query("change_journal", f"WITH {UPSERT} SELECT bet, o.note AS old_label, n.note AS new_label FROM o JOIN n USING (bet) WHERE o.note IS DISTINCT FROM n.note")
def journal(spark, sf):
    return L.change_journal(*versions(spark, sf), ["bet"], "note")


@query("lock_guard", f"WITH {BETS} SELECT bet, (bet % 3 = 0) OR epoch(TIMESTAMP '1998-06-01 06:00:00') - epoch(CAST(day AS TIMESTAMP)) > 86400 OR epoch(TIMESTAMP '1998-06-01 06:00:00') - epoch(CAST(day AS TIMESTAMP)) > 43200 AS locked FROM bets")
def lock(spark, sf):
    return L.lock_guard(bets(spark, sf), F.col("bet") % 3 == 0, "day", "day", "1998-06-01 06:00:00").select("bet", "locked")


@query("carry_over", f"WITH {UPSERT} SELECT bet, note FROM n UNION ALL SELECT bet, note FROM o WHERE bet NOT IN (SELECT bet FROM n)")
def carry(spark, sf):
    old, new = versions(spark, sf)
    return L.carry_over(old.select("bet", "note"), new.select("bet", "note"), ["bet"])


@query("precedence_fill", f"WITH {UPSERT} SELECT bet, coalesce(o.note, n.note) AS note, CASE WHEN o.note IS NOT NULL THEN 'primary' WHEN n.note IS NOT NULL THEN 'secondary' END AS source FROM o FULL JOIN n USING (bet)")
def precedence(spark, sf):
    return L.fill_by_precedence(*versions(spark, sf), ["bet"], "note")


@query("stale_poll_override", f"""WITH {LOG}, lv AS (SELECT entity, arg_max(k, ts) AS value, max(CASE WHEN kind = 'purchase' AND k > 80 THEN 1 ELSE 0 END) > 0 AS final FROM log GROUP BY entity), st AS (SELECT entity, max(k) AS outcome FROM log WHERE entity % 3 = 0 GROUP BY entity)
  SELECT entity, coalesce(outcome, value) AS value, final OR outcome IS NOT NULL AS final, outcome IS NOT NULL AND NOT final AS stale_poll FROM lv LEFT JOIN st USING (entity)""")
def stale_poll(spark, sf):
    e = log(spark, sf)
    live = e.groupBy("entity").agg(F.max_by("k", "ts").alias("value"), F.bool_or((F.col("kind") == "purchase") & (F.col("k") > 80)).alias("final"))
    done = e.filter("entity % 3 = 0").groupBy("entity").agg(F.max("k").alias("outcome"))
    return L.live_override(done, live, ["entity"]).select("entity", "value", "final", "stale_poll")


@query("grade_ledger", f"""WITH {BETS}, st AS (SELECT *, CASE WHEN bet % 11 = 0 THEN 'postponed' WHEN bet % 7 = 0 THEN 'live' WHEN bet % 13 = 0 THEN 'relieved' ELSE 'final' END AS state, bet % 17 = 0 AS absent FROM bets),
  g AS (SELECT *, CASE WHEN state = 'postponed' THEN 'POSTPONED' WHEN state = 'final' THEN CASE WHEN absent THEN 'VOID' ELSE grade END WHEN state = 'relieved' AND NOT absent THEN grade END AS settled FROM st)
  SELECT settled, count(*) AS n, round(sum(CASE settled WHEN 'WIN' THEN stake * ({D1} - 1) WHEN 'LOSS' THEN -stake WHEN 'PUSH' THEN 0 WHEN 'VOID' THEN 0 WHEN 'POSTPONED' THEN 0 END), 3) AS gain FROM g GROUP BY settled""")
def grade_ledger(spark, sf):
    b = bets(spark, sf)
    state = F.when(F.col("bet") % 11 == 0, "postponed").when(F.col("bet") % 7 == 0, "live").when(F.col("bet") % 13 == 0, "relieved").otherwise("final")
    absent = F.col("bet") % 17 == 0
    grade = F.when(state == "postponed", "POSTPONED").when((state == "final") & absent, "VOID").when(state == "final", F.col("grade")).when((state == "relieved") & ~absent, F.col("grade"))
    rows = b.withColumn("settled", grade).withColumn("gain", P.profit("settled", "stake", "odds"))
    return rows.groupBy("settled").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gain"), 3).alias("gain"))
