"""Candidate features of an entity's next episode, strictly as of its day, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.functions import context as X
from priorframe.plans import candidates as C, features as B
from priorframe.queries.aggregates import FLAGS, flagged
from priorframe.queries.base import LOG, query, r

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
GATES = C.Gates(zone=20, first=5, decay=15, measure=20, debut=3, full=2, early=1, late=(2, 3), days=10)

HABITS = f"""{LOG}{FLAGS}, q AS (SELECT entity, day, ts, event_id, kind <> 'error' AS done, success = 1 AS hit, CASE WHEN k <> 7 THEN value <= 50 END AS z, k % 4 = 0 AS fst, swing = 1 AS good, CASE WHEN k % 3 <> 0 THEN value END AS spin, CASE WHEN k % 5 <> 0 THEN k / 10.0::DOUBLE END AS ext,
    sum((kind <> 'error')::INT) OVER (PARTITION BY entity, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM f),
  hd AS (SELECT entity, day, count(*) AS n, count(*) FILTER (done) AS done, count(z) AS zn, count(*) FILTER (z) AS zi, count(*) FILTER (fst) AS fn, count(*) FILTER (fst AND good) AS fg, count(*) FILTER (done AND seq <= 1) AS en, count(*) FILTER (done AND hit AND seq <= 1) AS eh,
    count(*) FILTER (done AND seq BETWEEN 2 AND 3) AS ln, count(*) FILTER (done AND hit AND seq BETWEEN 2 AND 3) AS lh, count(spin) AS sn, coalesce(sum(spin), 0) AS ss, count(ext) AS xn, coalesce(sum(ext), 0) AS xs FROM q GROUP BY entity, day),
  hm AS (SELECT *, CASE WHEN sn > 0 THEN {{'nn': sum(sn) OVER near, 'ns': sum(ss) OVER near, 'an': sum(sn) OVER upto, 'asum': sum(ss) OVER upto}} END AS sp, CASE WHEN xn > 0 THEN {{'nn': sum(xn) OVER near, 'ns': sum(xs) OVER near, 'an': sum(xn) OVER upto, 'asum': sum(xs) OVER upto}} END AS xp
    FROM hd WINDOW near AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW), upto AS (PARTITION BY entity ORDER BY day)),
  hp AS (SELECT entity, day, coalesce(sum(done) OVER w, 0) AS done, coalesce(sum(zn) OVER w, 0) AS zn, coalesce(sum(zi) OVER w, 0) AS zi, coalesce(sum(fn) OVER w, 0) AS fn, coalesce(sum(fg) OVER w, 0) AS fg, coalesce(sum(en) OVER w, 0) AS en, coalesce(sum(eh) OVER w, 0) AS eh, coalesce(sum(ln) OVER w, 0) AS ln, coalesce(sum(lh) OVER w, 0) AS lh,
    last_value(sp IGNORE NULLS) OVER w AS sp, last_value(xp IGNORE NULLS) OVER w AS xp, last_value(CASE WHEN done >= 2 THEN n END IGNORE NULLS) OVER w AS prior_load, CAST(day - max(day) OVER w AS INTEGER) AS rest FROM hm WINDOW w AS (PARTITION BY entity ORDER BY day {PRIOR})),
  hs AS (SELECT entity, day, CASE WHEN zn >= 20 THEN zi / zn::DOUBLE END AS zone_share, CASE WHEN fn >= 5 THEN fg / fn::DOUBLE END AS first_share,
    CASE WHEN sp.an >= 20 AND sp.an > sp.nn THEN sp.ns / sp.nn - (sp.asum - sp.ns) / (sp.an - sp.nn) END AS spin_delta, CASE WHEN sp.an >= 20 AND sp.an > sp.nn THEN sp.ns / sp.nn END AS spin_recent,
    CASE WHEN xp.an >= 20 THEN xp.asum / xp.an END AS extension, CASE WHEN xp.an >= 20 AND xp.an > xp.nn THEN xp.ns / xp.nn - (xp.asum - xp.ns) / (xp.an - xp.nn) END AS extension_delta,
    CASE WHEN done >= 15 AND en > 0 AND ln > 0 THEN eh / en::DOUBLE END AS early_rate, CASE WHEN done >= 15 AND en > 0 AND ln > 0 THEN lh / ln::DOUBLE END AS late_rate, CASE WHEN done >= 15 AND en > 0 AND ln > 0 THEN lh / ln::DOUBLE - eh / en::DOUBLE END AS decay,
    prior_load, rest, CAST(done AS BIGINT) AS units, done / 3.0::DOUBLE AS innings, done < 3 AS is_debut FROM hp)"""


def habits(log):
    k, value = F.col("k"), F.col("value")
    return C.Habits(
        done=F.col("kind") != "error", hit=F.col("success") == 1, in_zone=F.when(k != 7, value <= 50), first_try=k % 4 == 0, good_try=F.col("swing") == 1,
        spin=F.when(k % 3 != 0, value), extension=F.when(k % 5 != 0, k / 10),
    )


def form(log):
    return C.habit_state(C.habit_days(log, "entity", ["day"], ["ts", "event_id"], habits(log), GATES), "entity", "day", GATES)


SHARES = ("zone_share", "first_share", "spin_delta", "spin_recent", "extension", "extension_delta", "early_rate", "late_rate", "decay")
ROUNDED = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in SHARES)


def steady(c: str):
    """Rounded so that halves which both engines see a bit differently fall alike."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


@query("personal_form", f"WITH {HABITS} SELECT entity, day, {ROUNDED}, prior_load, rest, units, round(innings, 6) AS innings, is_debut FROM hs")
def personal_form(spark, sf):
    return form(flagged(spark, sf)).select("entity", "day", *(steady(c) for c in SHARES), "prior_load", "rest", "units", r("innings"), "is_debut")


OPPONENTS = f"""mb AS (SELECT k, day, count(*) FILTER (kind <> 'error') AS n, count(*) FILTER (success = 1) AS h FROM log GROUP BY ALL),
  mg AS (SELECT *, coalesce(sum((n > 0)::INT) OVER w, 0) AS game, coalesce(sum(n) OVER w, 0) AS career FROM mb WINDOW w AS (PARTITION BY k ORDER BY day {PRIOR})),
  mk AS (SELECT k, day, career, sum(n) OVER w AS rn, sum(h) OVER w AS rh FROM mg WINDOW w AS (PARTITION BY k ORDER BY game RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  sl AS (SELECT * FROM (SELECT day, entity, k, row_number() OVER (PARTITION BY day, entity ORDER BY min(event_id)) AS pos FROM log GROUP BY day, entity, k) WHERE pos <= 9),
  op AS (SELECT sl.day, sl.entity, avg(CASE WHEN rn >= 4 THEN rh / rn::DOUBLE END) AS recent_rate, count(*) FILTER (career < 20) AS n_new, count(*) AS n_slots FROM sl JOIN mk USING (k, day) GROUP BY ALL)"""


def opponents(log):
    return C.opponents_form(log, ["day"], "entity", "k", "event_id", F.col("kind") != "error", F.col("success") == 1, 5, 4, 20)


@query("opponents_form", f"WITH {LOG}, {OPPONENTS} SELECT day, entity, round(recent_rate + 1e-9, 6) AS recent_rate, n_new, n_slots FROM op")
def opponents_form(spark, sf):
    return opponents(flagged(spark, sf)).select("day", "entity", steady("recent_rate"), "n_new", "n_slots")


CHASE = f"""cd AS (SELECT day, count(*) FILTER (value > 50) AS t, count(*) FILTER (value > 50 AND swing = 1) AS h FROM f GROUP BY day),
  ch AS (SELECT day, CASE WHEN coalesce(sum(t) OVER w, 0) > 100 THEN sum(h) OVER w / (sum(t) OVER w)::DOUBLE END AS league_chase FROM cd WINDOW w AS (ORDER BY day {PRIOR}))"""

#: What is known of an episode beforehand from outside the log.
CONTEXT = {
    "run_line": "CASE WHEN entity % 13 <> 0 THEN entity % 9 - 4.0 END", "total": "CASE WHEN entity % 11 <> 0 THEN 6.0 + dn % 7 END", "birth_year": "CASE WHEN entity % 17 <> 0 THEN 1960 + entity % 40 END",
    "humidity": "CASE WHEN dn % 9 <> 0 THEN 20.0 + (entity * 7 + dn * 3) % 60 END", "old_zone": "CASE WHEN entity % 6 <> 0 THEN -5 - entity % 4 END", "zone": "-5 - dn % 4",
    "days_there": "CASE WHEN dn % 6 <> 5 THEN dn % 6 END", "road": "CASE WHEN entity % 5 <> 4 THEN entity % 5 END", "game_number": "CASE WHEN entity % 3 <> 0 THEN 1 + (entity + dn) % 2 END",
}


def context(days):
    """days with the context columns, a model's probabilities by count and a ladder of prices (none for some entities)."""
    x = days.withColumn("dn", F.datediff("day", F.lit("2024-01-01").cast("date")))
    x = x.withColumns({name: F.expr(sql) for name, sql in CONTEXT.items()})
    pmf = F.expr("array(0.1D, 0.4D, 0.3D, 0.2D)")
    odds = F.expr("IF(entity % 7 = 0, CAST(array() AS array<int>), transform(array(-150 - entity % 50, 120 + dn, 400), o -> CAST(o AS int)))")
    return x.withColumn("ladder", X.ladder_divergence(pmf, F.expr("slice(array(1, 2, 5), 1, IF(entity % 7 = 0, 0, 3))"), odds)).withColumn("ladder_spread", F.col("ladder.spread")).withColumn("ladder_widest", F.col("ladder.widest"))


#: Candidates by name: each is built where the columns that it needs are present.
CANDIDATES = B.Registry()


def add(name, keys, build, sign=0, near=()):
    CANDIDATES.add(B.Feature(name, tuple(keys), build, sign, collinear_with=tuple(near)))


add("zone_pct", ["zone_share"], lambda df: F.col("zone_share"))
add("first_try", ["first_share"], lambda df: F.col("first_share"), 1, ["csw"])
add("spin_change", ["spin_delta"], lambda df: F.col("spin_delta"), 0, ["level_delta"])
add("spin_level", ["spin_recent"], lambda df: F.col("spin_recent"))
add("reach", ["extension"], lambda df: F.col("extension"), 1)
add("reach_change", ["extension_delta"], lambda df: F.col("extension_delta"))
add("opponents_recent", ["recent_rate"], lambda df: F.col("recent_rate"), 1, ["weighted_rate"])
add("new_opponents", ["n_new"], lambda df: F.col("n_new"), 1)
add("new_share", ["n_new", "n_slots"], lambda df: F.col("n_new") / F.col("n_slots"), 1, ["new_opponents"])
add("fade", ["decay"], lambda df: F.col("decay"), -1)
add("last_load", ["prior_load"], lambda df: F.col("prior_load"), -1)
add("days_rest", ["rest"], lambda df: F.col("rest"))
add("season_load", ["units"], lambda df: F.col("units"), -1)
add("season_innings", ["innings"], lambda df: F.col("innings"), -1, ["season_load"])
add("is_second_game", ["game_number"], lambda df: X.second_game("game_number"), -1)
add("blowout", ["run_line", "total"], lambda df: X.blowout_risk("run_line", "total"), -1)
add("debut", ["is_debut"], lambda df: F.col("is_debut"), -1)
add("official_age", ["birth_year", "day"], lambda df: X.official_age("birth_year", F.year("day")), -1)
add("grip", ["humidity"], lambda df: X.grip_penalty("humidity"), 1)
add("east_hours", ["old_zone", "zone"], lambda df: X.eastward_hours("old_zone", "zone"), -1)
add("travel", ["old_zone", "zone"], lambda df: X.travel_fatigue("old_zone", "zone"), -1, ["east_hours"])
add("is_adjusted", ["days_there"], lambda df: X.adjusted_to_zone("days_there"), 1)
add("road_games", ["road"], lambda df: F.coalesce("road", F.lit(0)), -1)
add("month", ["day"], lambda df: X.month_factor("day"), 1)
add("chase", ["league_chase"], lambda df: F.col("league_chase"), 1)
add("spread_of_ladder", ["ladder_spread"], lambda df: F.col("ladder_spread"))
add("widest_of_ladder", ["ladder_widest"], lambda df: F.col("ladder_widest"))

ODDS = "[-150 - entity % 50, 120 + dn, 400]"
CANDIDATE_SQL = f"""WITH {HABITS}, {OPPONENTS}, {CHASE},
  base AS (SELECT *, CAST(day - DATE '2024-01-01' AS INTEGER) AS dn FROM hs),
  cx AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in CONTEXT.items())}, CASE WHEN entity % 7 <> 0 THEN [0.9 + (-150 - entity % 50) / (250 + entity % 50)::DOUBLE, 0.5 - 100 / (220 + dn)::DOUBLE, -0.2::DOUBLE] END AS gaps FROM base),
  cg AS (SELECT *, list_stddev_pop(gaps) AS spread, CASE WHEN abs(gaps[2]) > abs(gaps[1]) THEN CASE WHEN abs(gaps[3]) > abs(gaps[2]) THEN gaps[3] ELSE gaps[2] END ELSE CASE WHEN abs(gaps[3]) > abs(gaps[1]) THEN gaps[3] ELSE gaps[1] END END AS widest FROM cx)
  SELECT entity, day, round(zone_share + 1e-9, 6) AS zone_pct, round(first_share + 1e-9, 6) AS first_try, round(spin_delta + 1e-9, 6) AS spin_change, round(spin_recent + 1e-9, 6) AS spin_level, round(extension + 1e-9, 6) AS reach, round(extension_delta + 1e-9, 6) AS reach_change,
    round(recent_rate + 1e-9, 6) AS opponents_recent, n_new AS new_opponents, round(n_new / n_slots::DOUBLE + 1e-9, 6) AS new_share, round(decay + 1e-9, 6) AS fade, prior_load AS last_load, rest AS days_rest, units AS season_load, round(innings + 1e-9, 6) AS season_innings,
    coalesce(game_number > 1, false) AS is_second_game, round(CASE WHEN run_line IS NOT NULL AND total IS NOT NULL THEN least((abs(run_line) / 3.0 + greatest(total - 8, 0) / 4.0) / 2.0, 1.0) END::DOUBLE + 1e-9, 6) AS blowout, is_debut AS debut, (year(day) - birth_year)::DOUBLE AS official_age,
    round(coalesce(CASE WHEN humidity < 35 THEN abs(humidity - 50) / 50.0 * -0.005 END, 0)::DOUBLE + 1e-9, 6) AS grip, CAST(coalesce(greatest(zone - old_zone, 0), 0) AS BIGINT) AS east_hours, round(coalesce(greatest(zone - old_zone, 0), 0) * 0.15::DOUBLE + 1e-9, 6) AS travel, coalesce(days_there >= 3, true) AS is_adjusted, CAST(coalesce(road, 0) AS BIGINT) AS road_games,
    CASE month(day) {' '.join(f'WHEN {m} THEN {f}' for m, f in X.MONTH_FACTORS.items())} ELSE 1.0 END::DOUBLE AS month, round(league_chase + 1e-9, 6) AS chase, round(spread + 1e-9, 6) AS spread_of_ladder, round(widest + 1e-9, 6) AS widest_of_ladder
  FROM cg JOIN op USING (entity, day) JOIN ch USING (day)"""


def candidates(log):
    """entity, day and all columns that the candidates need."""
    share = C.league_share(log, "day", F.col("value") > 50, F.col("swing") == 1, 100).withColumnRenamed("share", "league_chase")
    return context(form(log)).join(opponents(log), ["entity", "day"]).join(share, "day")


@query("candidate_features", CANDIDATE_SQL)
def candidate_features(spark, sf):
    x = CANDIDATES.apply(candidates(flagged(spark, sf)))
    doubles = {f.name for f in x.schema if f.dataType.typeName() == "double"} - {"official_age", "month"}
    names = list(CANDIDATES.features)
    return x.select("entity", "day", *(steady(n) if n in doubles else F.col(n).cast("long").alias(n) if n in ("east_hours", "road_games") else F.col(n) for n in names))
