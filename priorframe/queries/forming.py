"""Queries of whole feature groups as of each day: form, workload, members of a lineup."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.plans import form as P, lineup as L
from priorframe.queries.aggregates import FLAGS, flagged
from priorframe.queries.base import LOG, query, r
from priorframe.queries.candidates import steady
from priorframe.queries.lineups import SLOTS, WEIGHTS, lineups

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
KINDS, FAST = ("view", "click", "purchase", "signup", "error"), ("view", "click")
#: What a row of the log says, in Spark and in SQL alike.
SAYS = {
    "done": "kind <> 'error'", "hit": "success = 1", "swing": "swing = 1", "whiff": "whiff = 1", "called": "called = 1", "outside": "value > 50", "chased": "value > 50 AND swing = 1", "two": "k % 2 = 0", "two_hit": "k % 2 = 0 AND success = 1",
    "zone_n": "k <> 7", "zone_in": "k <> 7 AND value <= 50",
}
LEVEL = "CASE WHEN k % 3 <> 0 THEN value END"
BORN = "1990-05-01"


def sums(names) -> str:
    return ", ".join(f"coalesce(sum({c}) OVER w, 0) AS p_{c}" for c in names)


BY_KIND = [f"k{i}_{c}" for i in range(len(KINDS)) for c in ("n", "sw", "wh")]
DAYS = f"""{LOG}{FLAGS}, fd AS (SELECT entity, day, count(*) AS "rows", {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in SAYS.items())}, count({LEVEL}) AS level_n, coalesce(sum({LEVEL}), 0) AS level_sum,
    {', '.join(f"count(*) FILTER (kind = '{k}') AS k{i}_n, count(*) FILTER (kind = '{k}' AND swing = 1) AS k{i}_sw, count(*) FILTER (kind = '{k}' AND whiff = 1) AS k{i}_wh" for i, k in enumerate(KINDS))} FROM f GROUP BY entity, day),
  fp AS (SELECT entity, day, hit, done, coalesce(sum("rows") OVER w, 0) AS p_rows, {sums([*SAYS, *BY_KIND])}, coalesce(sum((done > 0)::INT) OVER w, 0) AS game,
    last_value(lv IGNORE NULLS) OVER w AS lv FROM (SELECT *, CASE WHEN level_n > 0 THEN {{'nn': sum(level_n) OVER near, 'ns': sum(level_sum) OVER near, 'an': sum(level_n) OVER upto, 'asum': sum(level_sum) OVER upto}} END AS lv FROM fd
      WINDOW near AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW), upto AS (PARTITION BY entity ORDER BY day)) WINDOW w AS (PARTITION BY entity ORDER BY day {PRIOR})),
  fr AS (SELECT *, {', '.join(f'sum(hit) OVER g{n} / nullif(sum(done) OVER g{n}, 0)::DOUBLE AS rolling_{n}' for n in P.ROLLING)} FROM fp WINDOW {', '.join(f'g{n} AS (PARTITION BY entity ORDER BY game RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)' for n in P.ROLLING)}),
  fs AS (SELECT *, {', '.join(f'p_k{i}_n / nullif(p_rows, 0)::DOUBLE AS u{i}, coalesce(p_k{i}_wh / nullif(p_k{i}_sw, 0)::DOUBLE, 0) AS h{i}' for i in range(len(KINDS)))} FROM fr)"""
ANY = "CASE WHEN p_rows > 0 THEN {} END"
FORM = {
    "whiff_share": ANY.format("p_whiff / p_rows::DOUBLE"), "whiff_or_called": ANY.format("(p_whiff + p_called) / p_rows::DOUBLE"), "rate": ANY.format("coalesce(p_hit / nullif(p_done, 0)::DOUBLE, 0)"),
    "rate_shrunk": ANY.format(f"(p_hit + {P.SHRINKAGE} * {P.LEAGUE}::DOUBLE) / (p_done + {P.SHRINKAGE})"), "chase": ANY.format("coalesce(p_chased / nullif(p_outside, 0)::DOUBLE, 0)"), "put_away": ANY.format("coalesce(p_two_hit / nullif(p_two, 0)::DOUBLE, 0)"),
    "rolling_3": "rolling_3", "rolling_5": "rolling_5", "rolling_10": "rolling_10", "trend": "CASE WHEN game >= 5 THEN rolling_5 - rolling_10 END",
    "level_delta": "CASE WHEN lv.an > lv.nn THEN lv.ns / lv.nn - (lv.asum - lv.ns) / (lv.an - lv.nn) END", "age": f"(day - DATE '{BORN}') / 365.25::DOUBLE", "zone_share": "CASE WHEN p_zone_n >= 20 THEN p_zone_in / p_zone_n::DOUBLE END",
    "mix_whiff": ANY.format("(" + " + ".join(f"u{i} * h{i}" for i in range(len(KINDS))) + ") / (" + " + ".join(f"u{i}" for i in range(len(KINDS))) + ")"), "fast_share": ANY.format("u0 + u1"),
}
FORM_INTS = {"total_rows": "CAST(p_rows AS BIGINT)", "total_units": "CAST(p_done AS BIGINT)", "n_found": "CAST(least(game, 10) AS BIGINT)", "breadth": ANY.format("CAST(" + " + ".join(f"(u{i} >= 0.10)::INT" for i in range(len(KINDS))) + " AS INTEGER)")}


def form_days(spark, sf):
    return P.form_days(flagged(spark, sf), "entity", "day", "kind", KINDS, {n: F.expr(c) for n, c in SAYS.items()}, F.expr(LEVEL))


def form_rows(days):
    return P.form_state(days, "entity", "day", KINDS, FAST, F.lit(BORN).cast("date"), 10, 20)


@query("form_asof", f"WITH {DAYS} SELECT entity, day, {', '.join(f'round({c} + 1e-9, 6) AS {n}' for n, c in FORM.items())}, {', '.join(f'{c} AS {n}' for n, c in FORM_INTS.items())} FROM fs")
def form_asof(spark, sf):
    """The whole form group of every entity and day."""
    x = form_rows(form_days(spark, sf))
    return x.select("entity", "day", *map(steady, FORM), *(F.col(n).cast("long").alias(n) if n in ("total_rows", "total_units", "n_found") else F.col(n) for n in FORM_INTS))


@query("mix_asof", f"""WITH {DAYS} SELECT entity, day, m.kind AS kind, round(m.u + 1e-9, 6) AS usage, round(m.h + 1e-9, 6) AS whiff_rate, CAST(m.n AS BIGINT) AS n FROM (SELECT entity, day, unnest([{', '.join(f"{{'kind': '{k}', 'u': u{i}, 'h': h{i}, 'n': p_k{i}_n}}" for i, k in enumerate(KINDS))}]) AS m FROM fs) WHERE m.n > 0""")
def mix_asof(spark, sf):
    """The mix of kinds as of each day, one row a kind that was used."""
    x = form_rows(form_days(spark, sf)).select("entity", "day", F.explode("mix").alias("kind", "m")).select("entity", "day", "kind", "m.*")
    return x.select("entity", "day", "kind", steady("usage"), steady("whiff_rate"), F.col("n").cast("long").alias("n"))


WORK = f"""{DAYS}, wd AS (SELECT entity, entity % 6 AS side, day, "rows", done, coalesce(sum((done >= 2)::INT) OVER (PARTITION BY entity ORDER BY day {PRIOR}), 0) AS game, CAST(day - lag(day) OVER (PARTITION BY entity ORDER BY day) AS INTEGER) AS rest FROM fd),
  wl AS (SELECT *, avg(done) FILTER (done >= 2) OVER g AS load_mean, CASE count(*) FILTER (done >= 2) OVER g WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE stddev_samp(done) FILTER (done >= 2) OVER g END AS load_std, CAST(count(*) FILTER (done >= 2) OVER g AS INTEGER) AS load_n FROM wd WINDOW g AS (PARTITION BY entity ORDER BY game RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
  ws AS (SELECT entity % 6 AS side, day, count(*) FILTER (done >= 2) AS n, coalesce(sum("rows") FILTER (done >= 2), 0) AS s, coalesce(sum("rows" * "rows") FILTER (done >= 2), 0) AS q, coalesce(sum("rows") FILTER (done < 2 AND done > 0), 0) AS o FROM fd GROUP BY ALL),
  wp AS (SELECT side, day, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0)::DOUBLE AS s, coalesce(sum(q) OVER w, 0)::DOUBLE AS q, CAST(coalesce(sum(o) OVER w2, 0) AS BIGINT) AS others_2d, CAST(coalesce(sum(o) OVER w3, 0) AS BIGINT) AS others_3d FROM ws
    WINDOW w AS (PARTITION BY side ORDER BY day {PRIOR}), w2 AS (PARTITION BY side ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), w3 AS (PARTITION BY side ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  wf AS (SELECT entity, day, {FORM['fast_share']} AS fast_share, {FORM_INTS['breadth']} AS breadth FROM fs)"""


@query("workload_asof", f"""WITH {WORK} SELECT wl.entity, wl.day, round(load_mean + 1e-9, 6) AS load_mean, round(load_std + 1e-9, 6) AS load_std, load_n, round(CASE WHEN wp.n > 0 THEN wp.s / wp.n ELSE 88.0 END + 1e-9, 6) AS leash_mean, round(CASE WHEN wp.n > 1 THEN sqrt(greatest((wp.q - wp.s * wp.s / wp.n) / (wp.n - 1), 0)) WHEN wp.n = 0 THEN 14.0 END + 1e-9, 6) AS leash_std,
  coalesce(fast_share > 0.6, false) AS fast_heavy, CASE WHEN fast_share > 0.6 THEN -0.04 WHEN breadth >= 4 THEN -0.02 WHEN fast_share IS NOT NULL THEN -0.03 ELSE 0 END::DOUBLE AS fade, coalesce(rest > 18, false) AS back_from_absence, CASE WHEN (wl.entity + (wl.day - DATE '2024-01-01')) % 13 = 0 THEN CAST(60 + wl.entity % 30 AS INTEGER) END AS announced_limit,
  others_2d, others_3d, others_2d > 20 AS others_heavy FROM wl JOIN wp ON wp.side = wl.side AND wp.day = wl.day JOIN wf ON wf.entity = wl.entity AND wf.day = wl.day""")
def workload_asof(spark, sf):
    """The whole workload group of every entity and day."""
    x = workload(spark, sf)
    return x.select(
        "entity", "day", steady("load_mean"), steady("load_std"), "load_n", steady("leash_mean"), steady("leash_std"), "fast_heavy", "fade", "back_from_absence", "announced_limit",
        F.col("others_2d").cast("long").alias("others_2d"), F.col("others_3d").cast("long").alias("others_3d"), "others_heavy",
    )


def workload(spark, sf):
    days = form_days(spark, sf)
    limits = days.select("entity", "day").filter((F.col("entity") + F.datediff("day", F.lit("2024-01-01").cast("date"))) % 13 == 0).withColumn("announced_limit", (60 + F.col("entity") % 30).cast("int"))
    return P.workload_state(days.withColumn("side", F.col("entity") % 6), "entity", "side", "day", form_rows(days), limits, 2, 20)


@query("load_distribution", f"""WITH {WORK}, g AS (SELECT a.entity, a.day, b.done AS units, count(*) AS c FROM wd a JOIN wd b ON a.entity = b.entity AND b.done >= 2 AND b.game < a.game AND b.game >= a.game - 10 AND b.day < a.day GROUP BY ALL)
  SELECT entity, day, units, round(c / sum(c) OVER (PARTITION BY entity, day)::DOUBLE + 1e-9, 6) AS share FROM g""")
def load_distribution(spark, sf):
    """The distribution of the last full episodes as of each day."""
    x = workload(spark, sf).select("entity", "day", F.explode("load_dist").alias("units", "share"))
    return x.select("entity", "day", F.col("units").cast("long").alias("units"), steady("share"))


@query("lineup_members", f"""WITH {SLOTS} SELECT day, entity, CAST(pos AS INTEGER) AS slot, stands AS side, round(rate + 1e-9, 6) AS rate, round(rate * own / (0.84::DOUBLE * rate * own + (0.225::DOUBLE - 0.84::DOUBLE * 0.225::DOUBLE * 0.225::DOUBLE)) + 1e-9, 6) AS matchup, w AS weight FROM sl""")
def lineup_members(spark, sf):
    """The list of members that each starter faces, one row a slot."""
    x = L.member_list(lineups(spark, sf), ["day", "entity"]).select("day", "entity", F.explode("members").alias("m")).select("day", "entity", "m.*")
    return x.select("day", "entity", "slot", "side", steady("rate"), steady("matchup"), "weight")
