"""Queries of the composed screen table, training sets, gates, dives and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.operators import asof
from priorframe.plans import dives as D, features as B, fit, gates as G, mixture as X, screen_table as T
from priorframe.queries import candidates as C
from priorframe.queries.aggregates import FLAGS, flagged
from priorframe.queries.base import EPISODES, LOG, episodes, log, query, r

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
steady = C.steady

#: Counts of a row of the log, in Spark and in SQL alike.
COUNTS = {
    "units": "CAST(kind <> 'error' AS INT)", "hits": "success", "rows": "1", "sw": "swing", "wh": "whiff", "far": "CAST(value > 50 AS INT)", "far_sw": "CAST(value > 50 AND swing = 1 AS INT)",
    "near_sw": "CAST(value <= 50 AND swing = 1 AS INT)", "near_wh": "CAST(value <= 50 AND whiff = 1 AS INT)", "two": "CAST(k % 2 = 0 AS INT)", "two_hit": "CAST(k % 2 = 0 AND success = 1 AS INT)",
    **{f"{c}_sw": f"CAST(k % 3 = {i} AND swing = 1 AS INT)" for i, c in enumerate(("fast", "bend", "slow"))}, **{f"{c}_wh": f"CAST(k % 3 = {i} AND whiff = 1 AS INT)" for i, c in enumerate(("fast", "bend", "slow"))},
    "length": "CASE WHEN swing = 1 THEN value ELSE 0 END", "speed": "CASE WHEN swing = 1 THEN k ELSE 0 END", "zone": "CAST(value <= 50 AS INT)", "called": "called", "first": "CAST(k % 4 = 0 AS INT)", "first_sw": "CAST(k % 4 = 0 AND swing = 1 AS INT)",
}
#: Opponents' rates and the weights they are shrunk with.
OPPONENT = {
    "o_rate": T.Rate("hits", "units", 200), "o_whiff": T.Rate("wh", "sw", 200), "o_chase": T.Rate("far_sw", "far", 300), "o_zone_miss": T.Rate("near_wh", "near_sw", 200), "o_per_unit": T.Rate("rows", "units", 200),
    "o_two": T.Rate("two_hit", "two", 100), "o_fast": T.Rate("fast_wh", "fast_sw", 150), "o_bend": T.Rate("bend_wh", "bend_sw", 150), "o_slow": T.Rate("slow_wh", "slow_sw", 150), "o_length": T.Rate("length", "sw"), "o_speed": T.Rate("speed", "sw"),
}
OWN = {"a_whiff": T.Rate("wh", "rows", 300), "a_zone": T.Rate("zone", "rows", 200), "a_first": T.Rate("first_sw", "first", 200), "a_rate": T.Rate("hits", "units", 100), "a_called": T.Rate("called", "rows", 300)}
MEMBER = {"b_rate": T.Rate("hits", "units", 100), "b_whiff": T.Rate("wh", "sw", 200), "b_chase": T.Rate("far_sw", "far", 300), "b_two": T.Rate("two_hit", "two", 100), "b_per_unit": T.Rate("rows", "units", 200)}
PLACE = {"e_rate": T.Rate("hits", "units", 400), "e_break": T.Rate("length", "sw", 300)}


def counted(rows, names=tuple(COUNTS)):
    return rows.withColumns({c: F.expr(COUNTS[c]) for c in names if c not in rows.columns})


def rates_sql(name: str, source: str, key: str, rates: dict, gate: int) -> str:
    """CTEs that end in one called name: key, epoch, day and the rates."""
    counts = list(dict.fromkeys(c for x in rates.values() for c in (x.top, x.bottom)))
    value = lambda x: f"p{x.top}::DOUBLE / nullif(p{x.bottom}, 0)" if x.weight is None else f"(p{x.top} + {x.weight}::DOUBLE * (l{x.top}::DOUBLE / nullif(l{x.bottom}, 0))) / (p{x.bottom} + {x.weight}::DOUBLE)"
    return f"""{name}_d AS (SELECT {key} AS key, epoch, day, {', '.join(f'sum({COUNTS[c]}) AS {c}' for c in counts)} FROM {source} GROUP BY ALL),
  {name}_p AS (SELECT key, epoch, day, row_number() OVER (PARTITION BY key, epoch ORDER BY day) - 1 AS seen, {', '.join(f'coalesce(sum({c}) OVER w, 0) AS p{c}' for c in counts)} FROM {name}_d WINDOW w AS (PARTITION BY key, epoch ORDER BY day {PRIOR})),
  {name}_l AS (SELECT epoch, day, {', '.join(f'coalesce(sum(sum({c})) OVER w, 0) AS l{c}' for c in counts)} FROM {name}_d GROUP BY epoch, day WINDOW w AS (PARTITION BY epoch ORDER BY day {PRIOR})),
  {name} AS (SELECT key, epoch, day, {', '.join(f'CASE WHEN seen >= {gate} THEN {value(x)} END AS {n}' for n, x in rates.items())} FROM {name}_p JOIN {name}_l USING (epoch, day))"""


def rounded(names) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)


@query("opponent_rates", f"WITH {LOG}{FLAGS}, {rates_sql('o', 'f', 'k % 6', OPPONENT, 2)} SELECT key AS team, epoch, day, {rounded(OPPONENT)} FROM o")
def opponent_rates(spark, sf):
    rows = counted(flagged(spark, sf)).withColumn("team", F.col("k") % 6)
    return T.shrunk_rates(rows, ["team"], "epoch", "day", OPPONENT, 2).select("team", "epoch", "day", *map(steady, OPPONENT))


@query("break_ratio", f"""WITH {LOG}{FLAGS}, d AS (SELECT entity % 6 AS place, epoch, day, sum({COUNTS['length']}) AS t, sum({COUNTS['sw']}) AS b FROM f GROUP BY ALL), p AS (SELECT place, epoch, day, coalesce(sum(t) OVER w, 0) AS pt, coalesce(sum(b) OVER w, 0) AS pb FROM d WINDOW w AS (PARTITION BY place, epoch ORDER BY day {PRIOR})),
  l AS (SELECT epoch, day, sum(sum(t)) OVER w / nullif(sum(sum(b)) OVER w, 0) AS m FROM d GROUP BY epoch, day WINDOW w AS (PARTITION BY epoch ORDER BY day {PRIOR})) SELECT place, epoch, day, round(CASE WHEN pb >= 20 THEN pt / pb / m END + 1e-9, 6) AS ratio FROM p JOIN l USING (epoch, day)""")
def break_ratio(spark, sf):
    """How far balls go at a place, against the league's of the same days."""
    rows = counted(flagged(spark, sf), ("length", "sw")).withColumn("place", F.col("entity") % 6)
    return T.ratio_to_league(rows, ["place"], "epoch", "day", "length", "sw", 20, "ratio").select("place", "epoch", "day", steady("ratio"))


SCREEN = f"""{EPISODES}{FLAGS}, {rates_sql('o', 'f', 'k % 6', OPPONENT, 2)}, {rates_sql('a', 'f', 'entity', OWN, 1)}, {rates_sql('b', 'f', 'k', MEMBER, 0)}, {rates_sql('e', 'f', 'entity % 6', PLACE, 2)},
  h AS (SELECT entity, epoch, day, n, s, CAST(count(*) OVER w AS BIGINT) AS starts, avg(n) OVER w AS mean_trials, avg(s) OVER w AS mean_hits, sum(s) OVER w / nullif(sum(n) OVER w, 0)::DOUBLE AS hit_rate, CASE WHEN count(s) OVER w3 >= 1 THEN avg(s) OVER w3 END AS last3, CASE WHEN count(s) OVER w5 >= 2 THEN avg(s) OVER w5 END AS last5, CAST(day - lag(day) OVER wl AS INTEGER) AS rest
    FROM ep WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR}), w3 AS (PARTITION BY entity, epoch ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY entity, epoch ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), wl AS (PARTITION BY entity, epoch ORDER BY day)),
  fc AS (SELECT DISTINCT entity, epoch, day, k FROM log), lb AS (SELECT fc.entity, fc.epoch, fc.day, {', '.join(f'avg({n}) AS L{n}' for n in MEMBER)} FROM fc JOIN b ON b.key = fc.k AND b.epoch = fc.epoch AND b.day = fc.day GROUP BY ALL),
  bp AS (SELECT entity, day, CAST(coalesce(sum(n) OVER w2, 0) AS BIGINT) AS load2, CAST(coalesce(sum(n) OVER w3, 0) AS BIGINT) AS load3 FROM ep WINDOW w2 AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), w3 AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  st AS (SELECT h.entity, h.epoch, h.day, h.n, h.s, starts, mean_trials, mean_hits, hit_rate, last3, last5, rest, {', '.join((*OWN, *OPPONENT, *PLACE))}, {', '.join(f'L{n}' for n in MEMBER)}, load2, load3, CAST((h.entity + (h.day - DATE '2024-01-01')) % 2 AS INTEGER) AS is_home
    FROM h JOIN a ON a.key = h.entity AND a.epoch = h.epoch AND a.day = h.day LEFT JOIN o ON o.key = (h.entity + (h.day - DATE '2024-01-01')) % 6 AND o.epoch = h.epoch AND o.day = h.day LEFT JOIN e ON e.key = h.entity % 6 AND e.epoch = h.epoch AND e.day = h.day
    JOIN lb ON lb.entity = h.entity AND lb.epoch = h.epoch AND lb.day = h.day JOIN bp ON bp.entity = h.entity AND bp.day = h.day)"""
HISTORY = ("mean_trials", "mean_hits", "hit_rate", "last3", "last5")
LINED = tuple(f"L{n}" for n in MEMBER)
REAL = (*HISTORY, *OWN, *OPPONENT, *PLACE, *LINED)
WHOLE = ("starts", "rest", "load2", "load3", "is_home")


def screen(spark, sf):
    """entity, epoch, day, n, s and the features of the screen: own rates, history, the day's opponents as a team and as members, place, load."""
    rows, ep = counted(flagged(spark, sf)), episodes(spark, sf)
    dn = F.datediff("day", F.lit("2024-01-01").cast("date"))
    keys = ["epoch", "day"]
    own = T.shrunk_rates(rows, ["entity"], *keys, OWN, 1)
    team = T.shrunk_rates(rows.withColumn("team", F.col("k") % 6), ["team"], *keys, OPPONENT, 2)
    place = T.shrunk_rates(rows.withColumn("place", F.col("entity") % 6), ["place"], *keys, PLACE, 2)
    member = T.shrunk_rates(rows, ["k"], *keys, MEMBER, 0)
    faced = rows.select("entity", *keys, "k").distinct().join(member, ["k", *keys]).groupBy("entity", *keys).agg(*(F.avg(n).alias(f"L{n}") for n in MEMBER))
    load = asof.calendar_window(asof.calendar_window(ep, ["entity"], "day", "n", 2, "load2"), ["entity"], "day", "n", 3, "load3").select("entity", "day", F.col("load2").cast("long").alias("load2"), F.col("load3").cast("long").alias("load3"))
    x = ep.select("entity", *keys, "n", "s").join(T.history(ep, "entity", *keys, "n", "s"), ["entity", *keys]).join(own, ["entity", *keys]).join(faced, ["entity", *keys]).join(load, ["entity", "day"])
    x = x.withColumn("team", (F.col("entity") + dn) % 6).withColumn("place", F.col("entity") % 6).withColumn("is_home", ((F.col("entity") + dn) % 2).cast("int"))
    return x.join(team, ["team", *keys], "left").join(place, ["place", *keys], "left").select("entity", *keys, "n", "s", *WHOLE, *REAL)


@query("screen_features", f"WITH {SCREEN} SELECT entity, epoch, day, n, s, {', '.join(WHOLE)}, {rounded(REAL)} FROM st")
def screen_features(spark, sf):
    return screen(spark, sf).select("entity", "epoch", "day", "n", "s", *WHOLE, *map(steady, REAL))


NOISE = 50


def noise_sql(i: int) -> str:
    base, mixed = f"(dk % {T.PRIME})", f"((dk % {T.PRIME}) * {T.BY_KEY + 2 * i + 1} + {i * T.BY_SEED}) % {T.PRIME}"
    return f"(({mixed}) * ({mixed}) + {base}) % {T.PRIME} / {T.PRIME}.0::DOUBLE AS noise_{i}"


@query("screen_design", f"""WITH {SCREEN} SELECT entity, epoch, day, {', '.join(WHOLE)}, {rounded(REAL)}, {', '.join(f'CAST({n} IS NULL AS INTEGER) AS m_{n}' for n in (*WHOLE, *REAL))}, CAST(coalesce(rest <= 4, false) AS INTEGER) AS rest_short, CAST(coalesce(rest >= 7, false) AS INTEGER) AS rest_long, CAST(rest IS NULL AS INTEGER) AS rest_unknown,
  {', '.join(noise_sql(i) for i in range(NOISE))} FROM (SELECT *, entity * 1000 + (day - DATE '2024-01-01') AS dk FROM st)""")
def screen_design(spark, sf):
    x = screen(spark, sf)
    key = F.col("entity") * 1000 + F.datediff("day", F.lit("2024-01-01").cast("date"))
    d = T.design(x, ["entity", "epoch", "day"], [*WHOLE, *REAL], key, NOISE)
    return d.select(*(steady(c) if c in REAL else F.col(c) for c in d.columns))


# --- training sets -----------------------------------------------------------------------------------

UNITS = f"""{LOG}, ed AS (SELECT entity, epoch, day, count(*) AS n, sum(success) AS s FROM log GROUP BY ALL), md AS (SELECT k, epoch, day, count(*) AS n, sum(success) AS s FROM log GROUP BY ALL),
  er AS (SELECT entity, epoch, day, coalesce(sum(n) OVER w, 0) AS pn, (coalesce(sum(s) OVER w, 0) + 70 * 0.225::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 70) AS rate FROM ed WINDOW w AS (PARTITION BY entity, epoch ORDER BY day {PRIOR})),
  mr AS (SELECT k, epoch, day, coalesce(sum(n) OVER w, 0) AS pn, (coalesce(sum(s) OVER w, 0) + 60 * 0.225::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 60) AS rate FROM md WINDOW w AS (PARTITION BY k, epoch ORDER BY day {PRIOR})),
  mt AS (SELECT *, row_number() OVER (PARTITION BY entity, k, day ORDER BY event_id) AS meeting FROM log)"""


def side_rate(spark, sf, key: str, weight: float):
    days = log(spark, sf).groupBy(key, "epoch", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("s"))
    x = B.entity_asof_table(days, key, "epoch", "day", "n", "s", weight, 0.225)
    return x.select(key, "epoch", "day", F.col("asof_shrunk").alias("rate"), F.col("prior_n").alias("prior"))


@query("unit_training_set", f"WITH {UNITS} SELECT event_id, entity, k, epoch, day, success AS y, round(ln(er.rate / (1 - er.rate)) + 1e-9, 6) AS entity_odds, round(ln(mr.rate / (1 - mr.rate)) + 1e-9, 6) AS member_odds, CAST(meeting = 2 AS INTEGER) AS second, CAST(meeting >= 3 AS INTEGER) AS later FROM mt JOIN er USING (entity, epoch, day) JOIN mr USING (k, epoch, day) WHERE er.pn >= 2 AND mr.pn >= 2")
def unit_training_set(spark, sf):
    """Single units: odds of both sides before the day, and which meeting it is."""
    x = units(spark, sf)
    return x.select("event_id", "entity", "k", "epoch", "day", "y", steady("entity_odds"), steady("member_odds"), "second", "later")


def units(spark, sf):
    return T.unit_rows(log(spark, sf), "entity", "k", "epoch", "day", "event_id", "success", side_rate(spark, sf, "entity", 70), side_rate(spark, sf, "k", 60), 2)


@query("game_training_set", f"WITH {SCREEN} SELECT entity, epoch, day, n, s, round(a_rate + 1e-9, 6) AS a_rate, round(o_rate + 1e-9, 6) AS o_rate, round(mean_trials + 1e-9, 6) AS mean_trials FROM st WHERE starts >= 2 AND a_rate IS NOT NULL AND o_rate IS NOT NULL")
def game_training_set(spark, sf):
    """Episodes with their own rate and that of the day's opponents, where there is enough of both."""
    x = screen(spark, sf).filter("starts >= 2 AND a_rate IS NOT NULL AND o_rate IS NOT NULL")
    return x.select("entity", "epoch", "day", "n", "s", steady("a_rate"), steady("o_rate"), steady("mean_trials"))


@query("member_training_set", f"""WITH {UNITS}, ft AS (SELECT k, epoch, day, arg_min(entity, event_id) AS entity FROM log GROUP BY ALL) SELECT md.k, md.epoch, md.day, md.n, CAST(md.s AS BIGINT) AS s, round(mr.rate + 1e-9, 6) AS member_rate, round(er.rate + 1e-9, 6) AS entity_rate
  FROM md JOIN mr USING (k, epoch, day) JOIN ft USING (k, epoch, day) JOIN er ON er.entity = ft.entity AND er.epoch = md.epoch AND er.day = md.day WHERE mr.pn >= 2""")
def member_training_set(spark, sf):
    """Members' days: their own rate before and that of the entity they met first."""
    e, keys = log(spark, sf), ["epoch", "day"]
    days = e.groupBy("k", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("s"), F.min_by("entity", "event_id").alias("entity"))
    member, entity = side_rate(spark, sf, "k", 60), side_rate(spark, sf, "entity", 70)
    x = days.join(member.withColumnRenamed("rate", "member_rate"), ["k", *keys]).filter("prior >= 2").drop("prior").join(entity.withColumnRenamed("rate", "entity_rate"), ["entity", *keys])
    return x.select("k", *keys, "n", "s", steady("member_rate"), steady("entity_rate"))


@query("retrain_stages")
def retrain_stages(spark, sf):
    """Both stages of the model refitted on all epochs: trials of an episode by least squares, hits of a unit by logistic regression."""
    a = screen(spark, sf).filter("starts >= 2").dropna(subset=["mean_trials", "a_rate"])
    first = fit.ols(a, ["mean_trials", "a_rate", "is_home"], "n")
    second = fit.logistic(units(spark, sf), ["entity_odds", "member_odds", "second", "later"], "y")
    tables = [f.table(spark).select(F.lit(stage).alias("stage"), "term", r("coef", 5), r("se", 5), F.lit(int(f.n)).cast("long").alias("n")) for stage, f in (("trials", first), ("hits", second))]
    return tables[0].unionByName(tables[1])


# --- gates and dives ---------------------------------------------------------------------------------

CLAIMS = {
    "zone_share": G.Claim(), "decay": G.Claim(-1, "weak"), "rest": G.Claim(0, "weak"), "recent_rate": G.Claim(1, "weak", ("units",)), "units": G.Claim(-1, "weak"), "same_day": G.Claim(1, "weak"),
}
LINES = {"0.5": ("p1", "y1"), "1.5": ("p2", "y2")}
EDGES = ["2024-01-12", "2024-01-20"]


def gate_features(rows):
    """Features of days, and one that leaks: what the entity does on the day itself."""
    own = rows.groupBy("entity", "day").agg(F.avg("success").alias("same_day"))
    return C.form(rows).join(C.opponents(rows), ["entity", "day"]).join(own, ["entity", "day"]).select("entity", "day", *CLAIMS)


def gate_table(spark, sf):
    ep = asof.prior_sums(episodes(spark, sf), ["entity"], ["day"], ["n", "s"])
    rate = (F.col("prior_s") + 4.0) / (F.col("prior_n") + 20.0)
    x = ep.select("entity", "day", "epoch", (F.col("s") >= 1).cast("int").alias("y1"), (F.col("s") >= 2).cast("int").alias("y2"), (1 - (1 - rate) * (1 - rate)).alias("p1"), (rate * rate).alias("p2"))
    key = F.col("entity") * 1000 + F.datediff("day", F.lit("2024-01-01").cast("date"))
    return x.join(gate_features(flagged(spark, sf)), ["entity", "day"]).withColumns({f"noise_{i}": T.lattice_noise(key, i) for i in range(3)})


def altered(rows, late):
    """The log with other outcomes from a day on."""
    return rows.withColumn("success", F.when(late, 1 - F.col("success")).otherwise(F.col("success"))).withColumn("value", F.when(late, 100 - F.col("value")).otherwise(F.col("value")))


@query("feature_gates")
def feature_gates(spark, sf):
    """All five gates of each feature; what an altered log changes before its edge is a leak."""
    rows, e = flagged(spark, sf), F.col("epoch")
    changed = G.leak_probe(rows, gate_features, ["entity", "day"], "day", list(CLAIMS), EDGES, altered)
    splits = {"a": (e <= 2, e == 3), "b": (e == 3, e <= 2), "c": (e <= 3, e >= 4)}
    table = gate_table(spark, sf).persist()
    out = G.feature_gates(table, CLAIMS, LINES, splits, ["epoch"], changed, ["noise_0", "noise_1", "noise_2"])
    table.unpersist()
    schema = "feature string, gate1 boolean, gate2 boolean, gate3 boolean, gate4 boolean, gate5 boolean, changed_rows long, gain_a double, gain_b double, gain_c double, coefficient double, verdict string, failed_at int"
    return spark.createDataFrame([tuple(x.values()) for x in out], schema)


@query("leak_probe", f"SELECT unnest(['zone_share', 'decay', 'rest', 'recent_rate', 'units']) AS feature, CAST(0 AS BIGINT) AS changed_rows UNION ALL (WITH {LOG}, x AS (SELECT entity, day, avg(success) AS y FROM log GROUP BY ALL) SELECT 'same_day', count(*) FILTER (day = DATE '{EDGES[0]}' AND y <> 0.5) + count(*) FILTER (day = DATE '{EDGES[1]}' AND y <> 0.5) FROM x)")
def leak_probe(spark, sf):
    """Rows up to an edge that change when the log is altered from it on: none but those of the planted leak."""
    changed = G.leak_probe(flagged(spark, sf), gate_features, ["entity", "day"], "day", list(CLAIMS), EDGES, altered)
    return spark.createDataFrame(list(changed.items()), "feature string, changed_rows long")


BASE, SURVIVORS = ["mean_trials", "hit_rate", "last5"], ["a_whiff", "a_zone", "o_rate", "Lb_rate", "is_home", "load3"]
SPLITS = {"a": ({1, 2}, {3}), "b": ({3}, {1, 2}), "c": ({1, 2, 3}, {4, 5})}


def terms(spark, sf):
    return D.moments(screen(spark, sf), [*BASE, *SURVIVORS, "o_chase", "Lb_chase", "o_two", "Lb_two"], "s", "epoch")


def rows_of(spark, found, columns: str):
    names = [c.split()[0] for c in columns.split(", ")]
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return spark.createDataFrame([tuple(clean(x.get(n)) for n in names) for x in found], columns)


PER_SPLIT = ", ".join(f"{k}_{s} double" for s in SPLITS for k in ("gain_pct", "t", "coef"))


@query("joint_drop_one")
def joint_drop_one(spark, sf):
    """Every term of base and survivors left out in turn, all from one aggregate of products."""
    return rows_of(spark, D.joint_drop_one(terms(spark, sf), BASE, SURVIVORS, SPLITS), f"term string, block string, verdict string, worst_gain_pct double, {PER_SPLIT}")


@query("candidate_screen")
def candidate_screen(spark, sf):
    """Every candidate on the base of the screen: error, paired t and calibration at a line, split by split."""
    columns = ", ".join(f"{k}_{s} double" for s in SPLITS for k in ("gain_pct", "t", "coef", "paired_t", "residual_r", "brier_gain"))
    found = D.candidate_screen(screen(spark, sf).persist(), BASE, [*SURVIVORS, "o_chase", "Lb_chase", "o_two", "Lb_two"], "s", "epoch", SPLITS)
    return rows_of(spark, found, f"term string, verdict string, worst_gain_pct double, {columns}")


@query("opponent_baseline")
def opponent_baseline(spark, sf):
    """Which representation of the opponents belongs in the model: each alone on a base without any."""
    return rows_of(spark, D.add_one(terms(spark, sf), BASE, ["Lb_rate", "o_rate", "Lb_chase", "o_chase", "Lb_two", "o_two"], SPLITS), f"term string, verdict string, worst_gain_pct double, {PER_SPLIT}")


@query("parsimony")
def parsimony(spark, sf):
    return rows_of(spark, D.parsimony(terms(spark, sf), [*BASE, *SURVIVORS], SPLITS, 0.1), "step int, dropped string, terms int, worst_loss_pct double, keep boolean")


@query("model_variants")
def model_variants(spark, sf):
    models = {"base": BASE, "lean": BASE[:2], "base and survivors": [*BASE, *SURVIVORS], "lean and opponents": [*BASE[:2], "Lb_rate"]}
    return rows_of(spark, D.variants(terms(spark, sf), models, SPLITS), "model string, terms int, rmse_a double, rmse_b double, rmse_c double")


@query("shuffle_control")
def shuffle_control(spark, sf):
    """The drop-one of shuffled targets: nothing should survive."""
    x = screen(spark, sf).withColumn("key", F.col("entity") * 1000 + F.datediff("day", F.lit("2024-01-01").cast("date")))
    by = D.moments(D.shuffled(x, "s", ["epoch"], "key", 7), [*BASE, *SURVIVORS], "s", "epoch")
    return rows_of(spark, D.joint_drop_one(by, BASE, SURVIVORS, SPLITS), f"term string, block string, verdict string, worst_gain_pct double, {PER_SPLIT}")


@query("unit_swap")
def unit_swap(spark, sf):
    """Terms of single units swapped: which way of telling the members apart scores best."""
    e = F.col("epoch")
    x = units(spark, sf).withColumn("odd_member", (F.col("k") % 2).cast("int"))
    models = {"member rate": ["entity_odds", "member_odds", "second"], "member kind": ["entity_odds", "odd_member", "second"], "both": ["entity_odds", "member_odds", "odd_member", "second"]}
    out = D.unit_swap(x, models, "y", {"a": (e <= 2, e == 3), "b": (e == 3, e <= 2), "c": (e <= 3, e >= 4)})
    return spark.createDataFrame([(x["split"], x["model"], round(x["brier"], 7)) for x in out], "split string, model string, brier double")


# --- mixture -----------------------------------------------------------------------------------------


def expected_counts(spark, sf):
    """Episodes with their units after the first, and the count that was expected: the mean of earlier ones, shrunk to that of all."""
    ep = episodes(spark, sf).withColumn("n", F.col("n") - 1).withColumn("one", F.lit(1).cast("long"))
    mean = F.lit(float(ep.agg(F.avg("n")).first()[0] or 1.0))
    x = asof.prior_sums(ep, ["entity"], ["day"], ["n", "one"])
    return x.withColumn("expected", (F.col("prior_n") + 10 * mean) / (F.col("prior_one") + 10))


@query("mixture_fit")
def mixture_fit(spark, sf):
    """Short and normal arm, both negative binomial, against one arm around the same expectation."""
    t = X.cells(expected_counts(spark, sf), "n", "expected")
    m = X.mixture_fit(t, [(0.05, 0.3), (0.2, 0.5)], (0.05, 1.0), 60, least=0.05)
    alone, loglik = X.fit_one(t)
    tails = [X.tail_error(t, f, (1, 2, 3)) for f in (m.log_pmf, lambda y, mean: X.log_pmf(y, mean, alone))]
    row = (m.share, m.short, m.short_dispersion, m.dispersion, m.loglik, alone, loglik, *tails, int(t[:, 2].sum()))
    return spark.createDataFrame([tuple(round(v, 6) if isinstance(v, float) else v for v in map(lambda v: float(v) if not isinstance(v, int) else v, row))], "share double, short double, short_dispersion double, dispersion double, loglik double, one_dispersion double, one_loglik double, tail_error double, one_tail_error double, n long")
