"""Queries of scalar functions, distributions, predicates, joins and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions import names as N, pmf as X, rates as R, park as V
from priorframe.functions.prices import innings_to_outs, parse_line
from priorframe.operators import aggregates as A, asof, episodes as epi, joins as J, ranking as K
from priorframe.queries.base import BETS, BULK, BULK_DAYS, EPISODES, LOG, bets, bulk, bulk_days, episodes, log, query, r, read
from priorframe.sources import files as S


@query("shrink_rate", f"WITH {EPISODES} SELECT entity, day, round((s + 70 * 0.225::DOUBLE) / (n + 70), 6) AS flat, round((s + 60 * (n / 20.0::DOUBLE)) / (n + 60), 6) AS by_prior FROM ep")
def shrink(spark, sf):
    return episodes(spark, sf).select("entity", "day", F.round(R.shrink_rate("s", "n"), 6).alias("flat"), F.round(R.shrink_rate("s", "n", F.col("n") / 20, 60), 6).alias("by_prior"))


@query("matchup_rate", f"WITH {BETS} SELECT bet, round(prob * 0.3 / (0.84 * prob * 0.3 + 0.225 - 0.84 * 0.225 * 0.225), 6) AS f, round(0.225 * 0.225 / (0.84 * 0.225 * 0.225 + 0.225 - 0.84 * 0.225 * 0.225), 6) AS at_league FROM bets")
def matchup(spark, sf):
    return bets(spark, sf).select("bet", F.round(R.matchup_rate("prob", 0.3), 6).alias("f"), F.round(R.matchup_rate(0.225, 0.225), 6).alias("at_league"))


@query("logit_sigmoid", f"WITH {BETS}, c AS (SELECT bet, greatest(least(prob * 1.3 - 0.1, 1 - 1e-6), 1e-6) AS p FROM bets) SELECT bet, round(p, 6) AS p, round(ln(p / (1 - p)), 6) AS x, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM c")
def logit(spark, sf):
    b = bets(spark, sf).withColumn("p", R.clamp(F.col("prob") * 1.3 - 0.1)).withColumn("x", R.logit("p"))
    return b.select("bet", r("p"), r("x"), F.round(R.sigmoid("x"), 6).alias("back"))


@query("air_density", """WITH v AS (SELECT n_nationkey, n_nationkey * 300.0::DOUBLE AS ft, 50 + n_nationkey * 2.0::DOUBLE AS tf, 30 + n_nationkey::DOUBLE AS h FROM nation), c AS (SELECT *, (tf - 32) * 5 / 9 AS tc FROM v),
  p AS (SELECT *, 101325 * pow(1 - 2.25577e-5 * ft * 0.3048, 5.25588) AS pa, 611.2 * exp(17.67 * tc / (tc + 243.5)) * h / 100 AS e FROM c)
  SELECT n_nationkey, round((pa - e) / (287.058 * (tc + 273.15)) + e / (461.495 * (tc + 273.15)), 7) AS rho, round(0.4 * (ft / 5280.0) * -0.02, 7) AS penalty FROM p""")
def air(spark, sf):
    v = read(spark, sf, "nation").withColumn("ft", F.col("n_nationkey") * 300.0).withColumn("tf", 50 + F.col("n_nationkey") * 2.0).withColumn("h", 30.0 + F.col("n_nationkey"))
    return v.select("n_nationkey", F.round(N.air_density("ft", "tf", "h"), 7).alias("rho"), F.round(N.altitude_penalty("ft", 0.4), 7).alias("penalty"))


@query("context_scores", f"""WITH {EPISODES}, l AS (SELECT entity, day, n, CAST(day - lag(day) OVER (PARTITION BY entity ORDER BY day) AS INTEGER) AS d FROM ep)
  SELECT entity, day, d AS rest, CASE WHEN d IS NULL THEN 'unknown' WHEN d <= 2 THEN '<=2' WHEN d <= 7 THEN CAST(d AS VARCHAR) WHEN d <= 10 THEN '8-10' WHEN d <= 20 THEN '11-20' ELSE '21+' END AS bucket,
    coalesce(d > 6, false) AS absent, round((day - DATE '1990-05-01') / 365.25::DOUBLE, 5) AS age, round(((day - DATE '2000-01-06') % 29.53059::DOUBLE), 5) AS lunar, round(n / 3.0::DOUBLE, 5) AS innings FROM l""")
def context(spark, sf):
    l = asof.lag_diff(episodes(spark, sf), ["entity"], ["day"], "day", "n")
    d = F.col("days_since_prior")
    return l.withColumn("born", F.lit("1990-05-01").cast("date")).select("entity", "day", d.alias("rest"), N.role_bucket("days_since_prior").alias("bucket"), N.long_absence("days_since_prior", 6).alias("absent"), F.round(N.age_years("born", "day"), 5).alias("age"), F.round(N.lunar_phase("day"), 5).alias("lunar"), F.round(F.col("n") / 3, 5).alias("innings"))


@query("bucketize", f"WITH {LOG} SELECT event_id, CASE WHEN k % 9 = 0 THEN 'unknown' WHEN k % 30 <= 2 THEN '<=2' WHEN k % 30 <= 7 THEN CAST(k % 30 AS VARCHAR) WHEN k % 30 <= 10 THEN '8-10' WHEN k % 30 <= 20 THEN '11-20' ELSE '21+' END AS bucket FROM log")
def bucketize(spark, sf):
    e = log(spark, sf).withColumn("d", F.when(F.col("k") % 9 != 0, F.col("k") % 30))
    return e.select("event_id", N.role_bucket("d").alias("bucket"))


@query("pitch_class", f"WITH {LOG} SELECT event_id, CASE kind WHEN 'view' THEN 'FB' WHEN 'click' THEN 'FB' WHEN 'purchase' THEN 'BB' WHEN 'signup' THEN 'OS' ELSE 'XX' END AS class FROM log")
def pitch_class(spark, sf):
    table = F.create_map(*(F.lit(x) for x in ("view", "FB", "click", "FB", "purchase", "BB", "signup", "OS")))
    return log(spark, sf).select("event_id", F.coalesce(table[F.col("kind")], F.lit("XX")).alias("class"))


@query("zone_geometry", f"""WITH {LOG}, z AS (SELECT event_id, (k - 50) / 40.0::DOUBLE AS x, CASE WHEN k % 13 = 0 THEN NULL ELSE value / 50 END AS z FROM log), d AS (SELECT event_id, greatest(abs(x) - 0.83, 1.5 - z, z - 3.4) AS d FROM z)
  SELECT event_id, round(d, 6) AS distance, d <= 0 AS inside, CASE WHEN abs(d) <= 0.25 THEN CAST(greatest(least(floor((d + 0.25) / 0.5 * 6), 5), 0) AS INTEGER) END AS shadow FROM d""")
def zone(spark, sf):
    e = log(spark, sf).withColumn("x", (F.col("k") - 50) / 40).withColumn("z", F.when(F.col("k") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50))
    e = e.withColumn("d", N.zone_distance("x", "z", 3.4, 1.5, 0.83))
    return e.select("event_id", F.round("d", 6).alias("distance"), (F.col("d") <= 0).alias("inside"), N.shadow_bin("d").alias("shadow"))


@query("role_side", f"WITH {LOG} SELECT event_id, CASE WHEN k % 2 = 0 THEN entity ELSE k END AS fielding, CASE WHEN k % 2 = 0 THEN k ELSE entity END AS batting FROM log")
def role_side(spark, sf):
    top = F.col("k") % 2 == 0
    return log(spark, sf).select("event_id", F.when(top, F.col("entity")).otherwise(F.col("k")).alias("fielding"), F.when(top, F.col("k")).otherwise(F.col("entity")).alias("batting"))


@query("eligibility_filter", f"WITH {EPISODES}, p AS (SELECT entity, day, n, count(*) OVER w AS g, coalesce(sum(n) OVER w, 0) AS t FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT entity, day FROM p WHERE n >= 2 AND g >= 3 AND t >= 10")
def eligible(spark, sf):
    rows = asof.prior_sums(episodes(spark, sf).withColumn("g", F.lit(1).cast("long")), ["entity"], ["day"], ["n", "g"])
    return rows.filter("n >= 2 and prior_g >= 3 and prior_n >= 10").select("entity", "day")


@query("startable_role_gate", f"""WITH {EPISODES}, l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY entity) AS c FROM ep WHERE entity % 5 <> 0 OR day < DATE '2024-01-03'),
  g AS (SELECT entity, max(c) AS c, quantile_cont(n, 0.6) FILTER (rn <= 8) AS typical FROM l GROUP BY entity)
  SELECT entity, CAST(c AS BIGINT) AS appearances, round(typical, 6) AS typical, CASE WHEN c < 3 THEN 'few_appearances' WHEN typical < 2.5 THEN 'short_outings' END AS reason, c >= 3 AND typical >= 2.5 AS startable FROM g""")
def role_gate(spark, sf):
    ep = episodes(spark, sf).filter((F.col("entity") % 5 != 0) | (F.col("day") < F.lit("2024-01-03").cast("date")))
    w = Window.partitionBy("entity")
    l = ep.withColumn("rn", F.row_number().over(w.orderBy(F.desc("day")))).withColumn("c", F.count(F.lit(1)).over(w))
    g = l.groupBy("entity").agg(F.max("c").alias("appearances"), F.percentile(F.when(F.col("rn") <= 8, F.col("n")), 0.6).alias("typical"))
    few, short = F.col("appearances") < 3, F.col("typical") < 2.5
    return g.select("entity", "appearances", r("typical"), F.when(few, "few_appearances").when(short, "short_outings").alias("reason"), (~few & ~short).alias("startable"))


@query("board_filter_rank", f"""WITH {BETS}, x AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN grade = 'PUSH' THEN 0 ELSE 1 END, prob DESC, bet) AS place FROM bets WHERE contains(lower(strength || ' ' || grade), 'build')) SELECT bet, place FROM x""")
def board(spark, sf):
    rows = bets(spark, sf).filter(F.lower(F.concat_ws(" ", "strength", "grade")).contains("build"))
    # Probabilities are below 1: the group and the probability in one value.
    rows = rows.withColumn("order", 2.0 * F.when(F.col("grade") == "PUSH", 0).otherwise(1) - F.col("prob"))
    return K.global_rank(rows, "order", ["bet"], "place").select("bet", (F.col("place") + 1).alias("place"))


@query("parse_reconstructed", f"WITH {LOG} SELECT event_id, NOT (CASE k % 6 WHEN 0 THEN 'false' WHEN 1 THEN '0.0' WHEN 2 THEN '' WHEN 3 THEN 'true' WHEN 4 THEN 'maybe' ELSE '' END IN ('0', '0.0', 'false', 'f', 'no', 'n', '')) AS reconstructed FROM log")
def reconstructed(spark, sf):
    flag = F.element_at(F.array(F.lit(" FALSE "), F.lit("0.0"), F.lit(""), F.lit("true"), F.lit("maybe"), F.lit(None)), F.col("k") % 6 + 1)
    return log(spark, sf).withColumn("flag", flag).select("event_id", N.parse_reconstructed("flag").alias("reconstructed"))


@query("split_overlap_guard", f"WITH {LOG} SELECT 'entity' AS key, (SELECT count(*) FROM (SELECT entity FROM log WHERE epoch <= 2 INTERSECT SELECT entity FROM log WHERE epoch > 2)) AS n UNION ALL SELECT 'day', (SELECT count(*) FROM (SELECT day FROM log WHERE epoch <= 2 INTERSECT SELECT day FROM log WHERE epoch > 2))")
def overlap(spark, sf):
    e = log(spark, sf)
    return J.split_overlap(e.filter("epoch <= 2"), e.filter("epoch > 2"), ["entity", "day"])


@query("split_faults", f"""WITH {LOG}, a AS (SELECT * FROM log WHERE epoch <= 2 OR entity % 50 = 7), b AS (SELECT * FROM log WHERE epoch > 2)
  SELECT 'epochs' AS "check", (SELECT count(*) FROM (SELECT epoch FROM a INTERSECT SELECT epoch FROM b)) AS n UNION ALL SELECT 'keys', (SELECT count(*) FROM (SELECT entity, day FROM a INTERSECT SELECT entity, day FROM b))
  UNION ALL SELECT 'days', (SELECT count(*) FROM (SELECT day FROM a INTERSECT SELECT day FROM b)) UNION ALL SELECT 'early_epochs', (SELECT count(DISTINCT epoch) FROM a WHERE epoch < 2)""")
def split_faults(spark, sf):
    """What makes a split unfit to train on: here some entities are on both sides, and one epoch is too old."""
    e = log(spark, sf)
    return J.split_faults(e.filter("epoch <= 2 OR entity % 50 = 7"), e.filter("epoch > 2"), "epoch", ["entity", "day"], "day", 2)


@query("park_weather", f"""WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey * 260.0::DOUBLE END AS alt, CASE WHEN s_suppkey % 5 <> 0 THEN 40 + s_nationkey * 2.0::DOUBLE END AS tf, CASE WHEN s_suppkey % 3 <> 0 THEN 30 + s_nationkey::DOUBLE END AS hum, CASE WHEN s_suppkey % 4 = 0 THEN 990.0::DOUBLE + s_nationkey END AS hpa,
    CASE s_suppkey % 4 WHEN 0 THEN 'dome' WHEN 1 THEN 'retractable' WHEN 2 THEN 'open' END AS roof, CASE WHEN s_suppkey % 6 <> 0 THEN 0.9 + s_nationkey / 100.0::DOUBLE END AS factor, CASE WHEN s_suppkey % 8 <> 0 THEN 0.15 + s_nationkey / 300.0::DOUBLE END AS misses, CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 10) / 20.0::DOUBLE END AS bend, 0.2::DOUBLE AS slide, 0.1::DOUBLE AS split FROM supplier),
  w AS (SELECT *, coalesce(alt, 0) AS h, (coalesce(tf, 72) - 32) * 5 / 9 AS tc, coalesce(hum, 50) AS rh FROM v), x AS (SELECT *, 100 * coalesce(hpa, 1013.25 * pow(1 - 2.25577e-5 * h * 0.3048, 5.25588)) AS pa, 611.2 * exp(17.67 * tc / (tc + 243.5)) * rh / 100 AS e FROM w),
  y AS (SELECT *, (pa - e) / (287.058 * (tc + 273.15)) + e / (461.495 * (tc + 273.15)) AS rho, 40 * 5 / 9.0::DOUBLE AS ts FROM x), z AS (SELECT *, 611.2 * exp(17.67 * ts / (ts + 243.5)) * 0.5 AS es FROM y), u AS (SELECT *, rho / ((101325 - es) / (287.058 * (ts + 273.15)) + es / (461.495 * (ts + 273.15))) AS ratio FROM z)
  SELECT s_suppkey, round(coalesce(factor, 1), 6) AS park_factor, round(coalesce(factor, 1) - ratio + 1e-9, 6) AS park_residual, round(coalesce(misses, 0.205) + 1e-9, 6) AS fast_misses_here, round(coalesce(misses, 0.205) - 0.205 + 1e-9, 6) AS fast_misses_delta, h AS height, round(coalesce(bend * (h / 5280.0) * -0.02, 0) + 1e-9, 6) AS bending_penalty, coalesce(bend > 0.35 AND h > 3000, false) AS bending_high,
    coalesce(roof, 'open') = 'dome' AS is_dome, coalesce(roof, 'open') = 'retractable' AS is_retractable, coalesce(roof, 'open') = 'open' AS is_open, round(coalesce(CASE WHEN tf < 60 THEN -(slide * 0.013 + split * 0.010) * (60 - tf) / 30 END, 0)::DOUBLE + 1e-9, 6) AS cold_penalty, round(rho + 1e-9, 6) AS density, round(ratio + 1e-9, 6) AS density_ratio FROM u""")
def park_weather(spark, sf):
    """The whole group of park and weather features of a venue and a forecast."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    v = read(spark, sf, "supplier").select(
        "s_suppkey", F.when(k % 7 != 0, n * 260.0).alias("alt"), F.when(k % 5 != 0, 40 + n * 2.0).alias("tf"), F.when(k % 3 != 0, 30.0 + n).alias("hum"), F.when(k % 4 == 0, 990.0 + n).alias("hpa"),
        F.when(k % 4 == 0, "dome").when(k % 4 == 1, "retractable").when(k % 4 == 2, "open").alias("roof"), F.when(k % 6 != 0, 0.9 + n / 100).alias("factor"), F.when(k % 8 != 0, 0.15 + n / 300).alias("misses"), F.when(k % 9 != 0, k % 10 / 20).alias("bend"), F.lit(0.2).alias("slide"), F.lit(0.1).alias("split"),
    )
    x = V.park_weather(v, "alt", "tf", "hum", "hpa", "roof", "factor", "misses", "bend", "slide", "split")
    near = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return x.select("s_suppkey", F.round("park_factor", 6).alias("park_factor"), *map(near, ("park_residual", "fast_misses_here", "fast_misses_delta")), "height", near("bending_penalty"), "bending_high", "is_dome", "is_retractable", "is_open", *map(near, ("cold_penalty", "density", "density_ratio")))


@query("normalize_name", r"""WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'José ' || c_name || ' Jr.' WHEN 1 THEN c_name || ' (LAA)' WHEN 2 THEN '  Ñandú   ' || c_name || ' III' ELSE c_name END AS n, c_name FROM customer)
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'jose ' || lower(c_name) WHEN 2 THEN 'nandu ' || lower(c_name) ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 4 = 1 THEN 'LAA' END AS tag FROM x""")
def normalize(spark, sf):
    c = read(spark, sf, "customer")
    m = F.col("c_custkey") % 4
    n = F.when(m == 0, F.concat(F.lit("José "), "c_name", F.lit(" Jr."))).when(m == 1, F.concat("c_name", F.lit(" (LAA)"))).when(m == 2, F.concat(F.lit("  Ñandú   "), "c_name", F.lit(" III"))).otherwise(F.col("c_name"))
    return c.withColumn("n", n).select("c_custkey", N.normalize_name("n").alias("name"), N.team_tag("n").alias("tag"))


@query("utc_to_local_date", f"WITH {LOG} SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local FROM log")
def local(spark, sf):
    return log(spark, sf).select("event_id", N.local_date("ts").alias("local"))


@query("innings_to_outs", f"WITH {LOG} SELECT event_id, (k // 10) * 3 + k % 3 AS outs FROM log")
def innings(spark, sf):
    return log(spark, sf).withColumn("ip", F.concat_ws(".", F.floor(F.col("k") / 10).cast("string"), (F.col("k") % 3).cast("string"))).select("event_id", innings_to_outs("ip").alias("outs"))


@query("parse_line", f"WITH {LOG} SELECT event_id, CASE WHEN k % 2 = 0 THEN k + 0.5::DOUBLE ELSE k::DOUBLE END AS line, k % 2 = 1 AS milestone FROM log")
def line(spark, sf):
    t = F.when(F.col("k") % 2 == 0, F.concat(F.col("k").cast("string"), F.lit(".5"))).otherwise(F.concat(F.col("k").cast("string"), F.lit("+")))
    return log(spark, sf).withColumn("t", t).select("event_id", parse_line("t")["value"].alias("line"), parse_line("t")["is_milestone"].alias("milestone"))


@query("negative_controls")
def controls(spark, sf):
    return log(spark, sf).select("event_id", F.round(N.seeded_noise("event_id", 7), 6).alias("noise"), F.round(N.lunar_phase("day"), 5).alias("lunar"))


# --- distributions -------------------------------------------------------------------------------


@query("negbin_pmf", f"""WITH {EPISODES}, m AS (SELECT entity, avg(n) AS mu FROM ep GROUP BY entity), k AS (SELECT entity, mu, 4.0::DOUBLE AS s, 4.0 / (4.0 + mu) AS p, unnest(range(0, 13)) AS k FROM m)
  SELECT entity, CAST(k AS INTEGER) AS k, round(exp(lgamma(k + s) - lgamma(s) - lgamma(k + 1) + s * ln(p) + k * ln(1 - p)), 7) AS p FROM k""")
def negbin(spark, sf):
    m = episodes(spark, sf).groupBy("entity").agg(F.avg("n").alias("mu"))
    return m.select("entity", F.posexplode(X.negbin_pmf(F.col("mu"), F.lit(0.25), 12)).alias("k", "p")).select("entity", "k", r("p", 7))


@query("hook_mixture_pmf", f"""WITH {EPISODES}, m AS (SELECT entity, avg(n) * 8 AS mu FROM ep GROUP BY entity), k AS (SELECT entity, mu, greatest((mu - {X.HOOK_SHARE}::DOUBLE * {X.HOOK_MEAN}::DOUBLE) / (1 - {X.HOOK_SHARE}::DOUBLE), 1.0) AS normal, unnest(range(0, 41)) AS k FROM m),
  t AS (SELECT entity, mu, k, {X.HOOK_SHARE}::DOUBLE * exp(lgamma(k + {1 / X.HOOK_ALPHA}) - lgamma({1 / X.HOOK_ALPHA}) - lgamma(k + 1) + {1 / X.HOOK_ALPHA} * ln({1 / X.HOOK_ALPHA} / ({1 / X.HOOK_ALPHA} + {X.HOOK_MEAN})::DOUBLE) + k * ln({X.HOOK_MEAN} / ({1 / X.HOOK_ALPHA} + {X.HOOK_MEAN})::DOUBLE))
    + (1 - {X.HOOK_SHARE}::DOUBLE) * exp(lgamma(k + 20.0) - lgamma(20.0) - lgamma(k + 1) + 20 * ln(20 / (20 + normal)) + k * ln(normal / (20 + normal))) AS p FROM k)
  SELECT entity, round(any_value(mu), 6) AS mu, round(sum(k * p) / sum(p), 5) AS mean, round(sum(p) FILTER (k >= 20) / sum(p), 5) AS p20 FROM t GROUP BY entity""")
def hook(spark, sf):
    m = episodes(spark, sf).groupBy("entity").agg((F.avg("n") * 8).alias("mu"))
    return m.withColumn("pmf", X.hook_mixture_pmf(F.col("mu"), F.lit(0.05))).select("entity", r("mu"), F.round(X.distribution_mean(F.col("pmf")), 5).alias("mean"), F.round(X.tail_at_least(F.col("pmf"), F.lit(20)), 5).alias("p20"))


def unit_probs(spark, sf):
    """Success probabilities of all units of an episode, in order."""
    p = log(spark, sf).groupBy("entity", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.lit(0.1) + F.col("k") / 250).alias("p")))).alias("l"))
    return p.select("entity", "day", F.transform("l", lambda x: x["p"]).alias("probs"))


#: Distributions after each unit of an episode, by recursion.
UNIT_PMFS = f"""{LOG}, u AS (SELECT entity, day, 0.1 + k / 250.0::DOUBLE AS p, row_number() OVER (PARTITION BY entity, day ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY entity, day) AS units FROM log),
  rec AS (SELECT DISTINCT entity, day, units, 0 AS n, [1.0::DOUBLE] AS pmf FROM u
    UNION ALL SELECT rec.entity, rec.day, rec.units, n + 1, [coalesce(pmf[i], 0) * (1 - p) + coalesce(pmf[i - 1], 0) * p for i in range(1, len(pmf) + 2)] FROM rec JOIN u ON u.entity = rec.entity AND u.day = rec.day AND u.rn = n + 1)"""


@query("poisson_binomial", f"WITH RECURSIVE {UNIT_PMFS}, x AS (SELECT entity, day, unnest(pmf) AS p, unnest(range(0, len(pmf))) AS k FROM rec WHERE n = units) SELECT entity, day, CAST(k AS INTEGER) AS k, round(p + 1e-11, 8) AS p FROM x")
def poisson_binomial(spark, sf):
    x = unit_probs(spark, sf).select("entity", "day", F.posexplode(X.poisson_binomial(F.col("probs"))).alias("k", "p"))
    return x.select("entity", "day", "k", F.round(F.col("p") + 1e-11, 8).alias("p"))


@query("poisson_binomial_mean", f"WITH {LOG}, x AS (SELECT entity, day, 0.1 + k / 250.0::DOUBLE AS p FROM log) SELECT entity, day, round(sum(p), 6) AS mean, round(exp(sum(ln(1 - p))) + 1e-11, 8) AS none, round(exp(sum(ln(p))) + 1e-11, 8) AS all_of FROM x GROUP BY entity, day")
def poisson_binomial_mean(spark, sf):
    x = unit_probs(spark, sf).withColumn("pmf", X.poisson_binomial(F.col("probs")))
    return x.select("entity", "day", F.round(X.distribution_mean(F.col("pmf")), 6).alias("mean"), F.round(F.col("pmf")[0] + 1e-11, 8).alias("none"), F.round(F.element_at("pmf", -1) + 1e-11, 8).alias("all_of"))


@query("compound_pmf", f"""WITH RECURSIVE {UNIT_PMFS}, t AS (SELECT k AS n, exp(lgamma(k + 20.0) - lgamma(20.0) - lgamma(k + 1) + 20 * ln(0.625::DOUBLE) + k * ln(0.375::DOUBLE)) AS w FROM (SELECT unnest(range(0, 21)) AS k)), v AS (SELECT n, w / (SELECT sum(w) FROM t) AS w FROM t),
  y AS (SELECT entity, day, n, unnest(pmf) AS p, unnest(range(0, len(pmf))) AS k FROM rec) SELECT entity, day, CAST(k AS INTEGER) AS k, round(sum(p * w) + 1e-11, 8) AS p FROM y JOIN v USING (n) GROUP BY entity, day, k""")
def compound(spark, sf):
    x = unit_probs(spark, sf).withColumn("trials", X.normalize(X.negbin_pmf(F.lit(12.0), F.lit(0.05), 20)))
    x = x.select("entity", "day", F.posexplode(X.compound(F.col("probs"), F.col("trials"))).alias("k", "p"))
    return x.select("entity", "day", "k", F.round(F.col("p") + 1e-11, 8).alias("p"))


@query("binomial_mixture", f"""WITH {EPISODES}, m AS (SELECT entity, avg(n) * 3 AS mean, greatest(coalesce(stddev_samp(n), 0.5), 0.5) AS sd, greatest(least(sum(s) / sum(n)::DOUBLE, 1 - 1e-12), 1e-12) AS q FROM ep GROUP BY entity),
  c AS (SELECT *, greatest(CAST(floor(mean - 3 * sd) AS INTEGER), 1) AS low, CAST(ceil(mean + 3 * sd) AS INTEGER) AS high FROM m), n AS (SELECT entity, mean, sd, q, greatest(low, high) AS top, unnest(range(low, greatest(low, high) + 1)) AS n FROM c), w AS (SELECT *, exp(-pow((n - mean) / sd, 2) / 2) AS w FROM n),
  x AS (SELECT entity, n, q, w / sum(w) OVER (PARTITION BY entity) AS w, unnest(range(0, top + 1)) AS k FROM w)
  SELECT entity, CAST(k AS INTEGER) AS k, round(sum(CASE WHEN k <= n THEN w * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(q) + (n - k) * ln(1 - q)) ELSE 0 END) + 1e-11, 7) AS p FROM x GROUP BY entity, k""")
def mixture(spark, sf):
    m = episodes(spark, sf).groupBy("entity").agg((F.avg("n") * 3).alias("mean"), F.stddev_samp("n").alias("sd"), (F.sum("s") / F.sum("n")).alias("p"))
    x = m.select("entity", F.posexplode(X.binomial_mixture(F.col("mean"), F.col("sd"), F.col("p"))).alias("k", "p"))
    return x.select("entity", "k", F.round(F.col("p") + 1e-11, 7).alias("p"))


@query("pmf_tail_sums", f"""WITH {EPISODES}, h AS (SELECT entity, least(n, 8) AS n, count(*) / sum(count(*)) OVER (PARTITION BY entity)::DOUBLE AS p FROM ep GROUP BY entity, least(n, 8)) SELECT entity, round(coalesce(sum(p) FILTER (n >= 3), 0), 6) AS at_least, round(coalesce(sum(p) FILTER (n > 3), 0), 6) AS above FROM h GROUP BY entity""")
def tails(spark, sf):
    n = F.least(F.col("n"), F.lit(8)).cast("int")
    pmf = F.array(*(F.avg((n == i).cast("double")) for i in range(9)))
    x = episodes(spark, sf).groupBy("entity").agg(pmf.alias("pmf"))
    return x.select("entity", F.round(X.tail_at_least(F.col("pmf"), F.lit(2.5)), 6).alias("at_least"), F.round(X.tail_above(F.col("pmf"), F.lit(3.0)), 6).alias("above"))


@query("outs_pmf", f"""WITH {EPISODES}, v AS (SELECT entity, avg(v) AS v FROM ep GROUP BY entity), c AS (SELECT entity, j, 1 / (1 + exp(-(3.0 - 0.35 * j + v / 200))) AS c FROM (SELECT entity, v, unnest(range(0, 9)) AS j FROM v)),
  a AS (SELECT *, coalesce(exp(sum(ln(c)) OVER (PARTITION BY entity ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS alive FROM c),
  p AS (SELECT entity, 3 * j + r AS x, alive * (1 - c) * [0.4, 0.35, 0.25][r + 1]::DOUBLE AS p FROM (SELECT *, unnest([0, 1, 2]) AS r FROM a) UNION ALL SELECT entity, 27, alive * c FROM a WHERE j = 8)
  SELECT entity, round(sum(p), 9) AS total, round(sum(p * x) + 1e-9, 6) AS mean FROM p GROUP BY entity""")
def outs(spark, sf):
    rates = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: R.sigmoid(3.0 - 0.35 * j + F.col("v") / 200))
    share = F.array_repeat(F.array(F.lit(0.4), F.lit(0.35), F.lit(0.25)), 9)
    x = episodes(spark, sf).groupBy("entity").agg(F.avg("v").alias("v")).withColumn("pmf", X.survival_pmf(rates, share))
    return x.select("entity", F.round(F.aggregate("pmf", F.lit(0.0), lambda a, b: a + b), 9).alias("total"), F.round(X.distribution_mean(F.col("pmf")) + 1e-9, 6).alias("mean"))


@query("pitch_limit_cap", f"WITH {EPISODES} SELECT entity, day, round(CASE WHEN n % 2 = 0 THEN least(n * 5, n * 10 / 3.8::DOUBLE) ELSE n * 5 END, 6) AS mu FROM ep")
def limit_cap(spark, sf):
    return episodes(spark, sf).select("entity", "day", F.round(X.capped_mean(F.col("n") * 5.0, F.when(F.col("n") % 2 == 0, F.col("n") * 10)), 6).alias("mu"))


@query("ladder_shape", f"WITH {LOG}, d AS (SELECT entity, k, 0.9 - k / 120.0::DOUBLE - value / 500 AS d FROM log) SELECT entity, round(stddev_pop(d), 5) AS sd, round(arg_max(d, abs(d)), 6) AS widest FROM d GROUP BY entity")
def shape(spark, sf):
    d = log(spark, sf).withColumn("d", 0.9 - F.col("k") / 120 - F.col("value") / 500)
    return d.groupBy("entity").agg(F.round(F.stddev_pop("d"), 5).alias("sd"), F.round(F.max_by("d", F.abs("d")), 6).alias("widest"))


# --- joins -------------------------------------------------------------------------------------------


@query("assemble_features", f"""WITH {EPISODES}, a AS (SELECT entity, day, sum(s) OVER w AS ps FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), b AS (SELECT entity, day, max(value) AS mv FROM log WHERE kind = 'view' GROUP BY ALL), c AS (SELECT entity, day, count(*) AS big FROM log WHERE k > 80 GROUP BY ALL)
  SELECT entity, day, n, CAST(ps AS BIGINT) AS ps, mv, big FROM ep LEFT JOIN a USING (entity, day) LEFT JOIN b USING (entity, day) LEFT JOIN c USING (entity, day)""")
def assemble(spark, sf):
    ep, e = episodes(spark, sf), log(spark, sf)
    a = ep.withColumn("ps", F.sum("s").over(Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("entity", "day", "ps")
    b = e.filter("kind = 'view'").groupBy("entity", "day").agg(F.max("value").alias("mv"))
    c = e.filter("k > 80").groupBy("entity", "day").agg(F.count(F.lit(1)).alias("big"))
    return J.assemble(ep.select("entity", "day", "n"), [a, b, c], ["entity", "day"])


@query("inner_join_starters", f"WITH {LOG}, s AS (SELECT day, arg_min(entity, event_id) AS entity FROM log GROUP BY day) SELECT event_id, entity, day FROM log JOIN s USING (day, entity)")
def inner(spark, sf):
    e = log(spark, sf)
    s = epi.starter(e, ["day"], "entity", "event_id").withColumnRenamed("starter", "entity")
    return e.join(s, ["day", "entity"]).select("event_id", "entity", "day")


@query("semi_join_members", f"WITH {LOG} SELECT event_id, entity IN (SELECT entity FROM log WHERE kind = 'purchase' AND k > 90) AS member FROM log")
def semi(spark, sf):
    e = log(spark, sf)
    return J.is_member(e, e.filter("kind = 'purchase' and k > 90"), ["entity"], "member").select("event_id", "member")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("prior_day_join", f"""WITH {LOG}, d AS (SELECT entity, day, count(*) AS n FROM log GROUP BY ALL), p AS (SELECT entity, day, CAST(coalesce(sum(n) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_n FROM d) SELECT event_id, prior_n FROM log JOIN p USING (entity, day)""")
def prior_join(spark, sf):
    e = log(spark, sf).withColumn("n", F.lit(1).cast("long"))
    return e.join(asof.prior_day_totals(e, ["entity"], "day", ["n"]).select("entity", "day", "prior_n"), ["entity", "day"]).select("event_id", "prior_n")


@query("opposing_entity", f"WITH {LOG}, s AS (SELECT day, k % 2 AS side, arg_min(entity, event_id) AS entity, count(*) AS n FROM log GROUP BY ALL) SELECT a.day, a.entity, a.n, b.entity AS opp_entity, b.n AS opp_n FROM s a JOIN s b ON a.day = b.day AND a.entity <> b.entity")
def opposing(spark, sf):
    s = log(spark, sf).groupBy("day", (F.col("k") % 2).alias("side")).agg(F.min_by("entity", "event_id").alias("entity"), F.count(F.lit(1)).alias("n"))
    return J.opposing(s, ["day"], "entity", ["n"]).select("day", "entity", "n", "opp_entity", "opp_n")


@query("fuzzy_entity_match", """WITH r AS (SELECT s_suppkey AS entity, 'ann lee' || CAST(s_suppkey % 40 AS VARCHAR) AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'AA' ELSE 'BB' END AS team FROM supplier),
  p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'bo' ELSE 'ann' END || ' lee' || CAST(c_custkey % 60 AS VARCHAR) AS n, 'lee' || CAST(c_custkey % 60 AS VARCHAR) AS l, CASE WHEN c_custkey % 5 = 0 THEN 'AA' WHEN c_custkey % 5 = 1 THEN 'BB' END AS tag FROM customer),
  j AS (SELECT p.c_custkey, tag, entity, team, CASE WHEN p.n = r.n THEN 1 ELSE 0 END AS fullname FROM p JOIN r ON p.l = split_part(r.n, ' ', 2)), f AS (SELECT *, max(fullname) OVER (PARTITION BY c_custkey) AS anyfull FROM j), g AS (SELECT * FROM f WHERE anyfull = fullname),
  h AS (SELECT *, coalesce(team = tag, false) AS ontag, max(CASE WHEN coalesce(team = tag, false) THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey) AS anytag FROM g), i AS (SELECT c_custkey, max(fullname) AS fl, count(*) AS c, max(entity) AS entity FROM h WHERE anytag = 0 OR ontag GROUP BY c_custkey)
  SELECT p.c_custkey, CASE WHEN c = 1 THEN i.entity END AS entity, CASE WHEN c IS NULL THEN 'no_match' WHEN c > 1 THEN 'ambiguous' WHEN fl = 1 THEN 'full_name' ELSE 'last_name' END AS reason FROM p LEFT JOIN i USING (c_custkey)""")
def fuzzy(spark, sf):
    roster = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Ánn  Lee"), (F.col("s_suppkey") % 40).cast("string"), F.lit(" Jr.")).alias("n"), F.when(F.col("s_suppkey") % 2 == 0, "aa").otherwise("bb").alias("team"))
    c = F.col("c_custkey")
    name = F.concat(F.when(c % 3 == 0, "Bo").otherwise("Ann"), F.lit(" Lee"), (c % 60).cast("string"), F.when(c % 5 == 0, " (AA)").when(c % 5 == 1, " (bb)").otherwise(""))
    props = read(spark, sf, "customer").select("c_custkey", name.alias("prop"))
    return J.match_names(props, roster, "prop", "c_custkey", "n", "s_suppkey", "team")


@query("lineup_join", f"""WITH {LOG}, rt AS (SELECT k, avg(success) AS rate FROM log WHERE k % 7 <> 0 GROUP BY k), q AS (SELECT entity, epoch, k, row_number() OVER (PARTITION BY entity, epoch ORDER BY ts, event_id) AS slot FROM log), j AS (SELECT q.*, rate, 1.2 - 0.05 * slot AS w FROM q LEFT JOIN rt USING (k) WHERE slot <= 9)
  SELECT entity, epoch, round(CASE WHEN count(rate) >= 8 THEN sum(rate * w) / sum(CASE WHEN rate IS NOT NULL THEN w END) END, 6) AS rate, count(rate) AS known FROM j GROUP BY ALL""")
def lineup(spark, sf):
    e = log(spark, sf)
    rates = e.filter("k % 7 <> 0").groupBy("k").agg(F.avg("success").alias("rate"))
    return J.slot_weighted(e.select("entity", "epoch", "k", "ts", "event_id"), ["entity", "epoch"], ["ts", "event_id"], rates, "k", "rate", [1.2 - 0.05 * i for i in range(1, 10)], 8).select("entity", "epoch", r("rate"), "known")


@query("frozen_baseline_join", f"WITH {BULK}, b AS (SELECT slot, avg(success) AS base FROM bulk WHERE epoch <= 1996 GROUP BY slot) SELECT epoch, round(avg(success - base), 6) AS excess, count(*) AS n FROM bulk LEFT JOIN b USING (slot) GROUP BY epoch")
def frozen(spark, sf):
    x = J.frozen_baseline(bulk(spark, sf), F.col("epoch") <= 1996, ["slot"], "success", "base")
    return x.groupBy("epoch").agg(F.round(F.avg(F.col("success") - F.col("base")), 6).alias("excess"), F.count(F.lit(1)).alias("n"))


@query("dominant_partner", f"WITH {LOG}, c AS (SELECT entity, kind, count(*) AS n FROM log GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, kind) AS place FROM c) SELECT entity, kind, n, CAST(place AS INTEGER) AS place FROM p WHERE place <= 2")
def dominant(spark, sf):
    return epi.dominant_partner(log(spark, sf), ["entity"], "kind", 2).select("entity", "kind", "n", "place")


@query("top_k_per_group", f"WITH {LOG}, p AS (SELECT kind, event_id, value, row_number() OVER (PARTITION BY kind ORDER BY value DESC, event_id) AS rank FROM log) SELECT kind, event_id, value, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3")
def top_k(spark, sf):
    from priorframe.operators.ranking import top_k as top

    return top(log(spark, sf), ["kind"], [F.desc("value"), F.asc("event_id")], 3).select("kind", "event_id", "value", "rank")


@query("dedupe_keep_last", f"WITH {LOG} SELECT entity, day, arg_max(kind, event_id) AS kind FROM log GROUP BY ALL")
def keep_last(spark, sf):
    from priorframe.operators.ranking import keep_last as last

    return last(log(spark, sf), ["entity", "day"], [F.col("event_id")]).select("entity", "day", "kind")


@query("union_by_name", "SELECT n_nationkey AS key, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("except_intersect_keys", f"WITH {LOG}, a AS (SELECT DISTINCT entity, kind FROM log WHERE epoch <= 2), b AS (SELECT DISTINCT entity, kind FROM log WHERE epoch > 2) SELECT 'missing' AS what, count(*) AS n FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'covered', count(*) FROM (FROM a INTERSECT FROM b)")
def except_keys(spark, sf):
    e = log(spark, sf)
    a, b = e.filter("epoch <= 2").select("entity", "kind").distinct(), e.filter("epoch > 2").select("entity", "kind").distinct()
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return n(a.subtract(b), "missing").unionByName(n(a.intersect(b), "covered"))


# --- sources -------------------------------------------------------------------------------------------


@query("scan_date_range", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1")
def scan(spark, sf):
    schema = read(spark, sf, "events").select("event_id", "ts").schema
    rows = S.scan_log(spark, f"{sf}/events.parquet", schema, "ts", "2024-01-05", "2024-01-12")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_schema_guard", "SELECT event_id, user_id, CAST(NULL AS DOUBLE) AS absent FROM events WHERE event_type <> 'error'")
def guard(spark, sf):
    from pyspark.sql import types as T

    known = read(spark, sf, "events").select("event_id", "user_id", "event_type").schema
    schema = T.StructType([*known.fields, T.StructField("absent", T.DoubleType())])
    return spark.read.schema(schema).parquet(f"{sf}/events.parquet").filter("event_type <> 'error'").select("event_id", "user_id", "absent")


@query("normalize_columns", "SELECT event_id AS key, user_id AS entity, CAST(value AS DOUBLE) AS measure FROM events")
def normalized(spark, sf):
    return S.normalize_columns(read(spark, sf, "events"), {"key": ("event_id", "id"), "entity": ("player", "user_id"), "measure": ("value",)}, {"measure": "double"})


@query("entity_crosswalk", "WITH x AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'x' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS k, c_name FROM customer) SELECT TRY_CAST(k AS BIGINT) AS k, min(c_name) AS c_name FROM x WHERE TRY_CAST(k AS BIGINT) IS NOT NULL GROUP BY 1")
def crosswalk(spark, sf):
    c = read(spark, sf, "customer").withColumn("k", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")))
    return S.crosswalk(c, "k", ["c_name"])


@query("manual_override_lookup", "SELECT o_orderkey, TRY_CAST(CASE WHEN c_nationkey % 4 = 0 THEN 'n/a' ELSE CAST(c_nationkey * 4 AS VARCHAR) END AS INTEGER) AS unit_limit FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0")
def override(spark, sf):
    c = read(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") % 4 == 0, "n/a").otherwise((F.col("c_nationkey") * 4).cast("string")).alias("t"))
    return read(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.col("t").try_cast("int").alias("unit_limit"))


def boards(spark, sf):
    """Market documents of parts of days, made of the log."""
    e = log(spark, sf).groupBy("day", "entity").agg(F.max("k").alias("k"), F.min("event_id").alias("id"), F.round(F.avg("value"), 1).alias("v"))
    event = F.struct(F.col("day").cast("string").alias("id"), F.col("day").cast("string").alias("start"), F.array(F.struct(F.lit("home").alias("role"), F.lit("AA").alias("abbr"))).alias("teams"))
    market = F.struct(F.col("id").cast("string").alias("id"), F.col("day").cast("string").alias("event"), F.concat(F.lit("Player "), F.col("entity").cast("string"), F.lit(" Strikeouts")).alias("name"))
    chosen = lambda label, odds: F.struct(F.col("id").cast("string").alias("market"), F.lit(label).alias("label"), (F.col("k") + 0.5).alias("points"), odds.alias("odds"))
    over, under = chosen("Over", F.lit("+110")), chosen("Under", F.concat(F.lit("−"), (100 + F.col("k")).cast("string")))
    rows = e.groupBy("day", S.slate_part("entity")).agg(F.array_distinct(F.collect_list(event)).alias("events"), F.collect_list(market).alias("markets"), F.flatten(F.collect_list(F.array(over, under))).alias("selections"))
    return rows.select(F.to_json(F.struct("events", "markets", "selections")).alias("board"))


@query("explode_board_ou", f"WITH {LOG} SELECT CAST(day AS VARCHAR) AS event, 'Player ' || CAST(entity AS VARCHAR) AS entity, 'AA' AS home, max(k) + 0.5::DOUBLE AS line, '+110' AS over_odds, '−' || CAST(100 + max(k) AS VARCHAR) AS under_odds FROM log GROUP BY day, log.entity")
def board_ou(spark, sf):
    return S.explode_board(boards(spark, sf), "board", " Strikeouts").select("event", "entity", "home", "line", "over_odds", "under_odds")


@query("flatten_slate", f"WITH {LOG} SELECT day AS date, false AS reconstructed, entity AS pitcher_id, 2.5::DOUBLE AS line, k AS milestone, CAST(round(min(value)) AS INTEGER) AS odds FROM log GROUP BY day, entity, k")
def slate(spark, sf):
    return flat_slate(log(spark, sf))


@query("flatten_slate_all", f"WITH {LOG} SELECT day AS date, false AS reconstructed, entity AS pitcher_id, 2.5::DOUBLE AS line, k AS milestone, CAST(round(min(value)) AS INTEGER) AS odds FROM log GROUP BY day, entity, k")
def slate_all(spark, sf):
    return flat_slate(log(spark, sf))


def flat_slate(rows):
    """Slate documents of parts of days, made of rows, and flattened."""
    e = rows.groupBy("day", "entity", "k").agg(F.round(F.min("value")).cast("int").alias("odds"))
    ladder = F.sort_array(F.collect_list(F.struct(F.col("k").alias("milestone"), "odds"))).alias("ladder")
    p = e.groupBy("day", "entity").agg(ladder).select("day", "entity", F.struct(F.col("entity").alias("pitcher_id"), F.lit(2.5).alias("line"), "ladder").alias("p"))
    docs = p.groupBy("day", S.slate_part("entity")).agg(F.collect_list("p").alias("pitchers")).select(F.to_json(F.struct(F.col("day").alias("date"), F.lit(False).alias("reconstructed"), "pitchers")).alias("doc"))
    return S.flatten_slate(docs, "doc").select("date", "reconstructed", "pitcher_id", "line", "milestone", "odds")


@query("nest_slate_counts", f"WITH {EPISODES} SELECT day, count(*) AS entities FROM ep GROUP BY day")
def nest(spark, sf):
    rows = log(spark, sf).groupBy("day", "entity", F.col("k").alias("milestone")).agg(F.max("value").alias("odds")).withColumn("line", F.lit(2.5))
    docs = S.nest_slate(rows, "day", "entity", ["line"], ["milestone", "odds"])
    return docs.groupBy("day").agg(F.sum(F.json_array_length(F.get_json_object("document", "$.pitchers")).cast("long")).alias("entities"))


@query("game_context", f"WITH {LOG}, x AS (SELECT day, k % 2 AS side, k, row_number() OVER (PARTITION BY day, k % 2 ORDER BY event_id) AS pos FROM log) SELECT day AS date, CASE side WHEN 0 THEN 'home' ELSE 'away' END AS side, CAST(pos AS INTEGER) AS pos, CAST(k AS BIGINT) AS batter, 'confirmed' AS lineup_source FROM x WHERE pos <= 9")
def game(spark, sf):
    x = log(spark, sf).withColumn("side", F.col("k") % 2).withColumn("pos", F.row_number().over(Window.partitionBy("day", "side").orderBy("event_id"))).filter("pos <= 9")
    l = x.groupBy("day", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "k"))), lambda s: s["k"]).alias("lineup"))
    team = lambda s: F.struct(F.lit(s).alias("id"), F.max(F.when(F.col("side") == s, F.col("lineup"))).alias("lineup"))
    docs = l.groupBy("day").agg(team(0).alias("home"), team(1).alias("away")).select(F.to_json(F.struct(F.datediff("day", F.lit("2024-01-01")).alias("game"), F.col("day").alias("date"), "home", "away")).alias("doc"))
    return S.game_context(docs, "doc").select("date", "side", "pos", "batter", "lineup_source")


@query("snapshot_select", f"WITH {LOG} SELECT event_id, kind, day FROM log WHERE day = (SELECT max(day) FROM log) AND kind = (SELECT kind FROM log WHERE day = (SELECT max(day) FROM log) GROUP BY kind ORDER BY max(ts) DESC LIMIT 1)")
def snapshot(spark, sf):
    e = log(spark, sf).withColumn("file", F.concat_ws("_", "kind", F.col("day").cast("string")))
    return S.snapshot_select(e, "file", "day", "ts", F.length("kind")).select("event_id", "kind", "day")
