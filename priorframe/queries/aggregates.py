"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import gated_rate, safe_rate, shrink_rate
from priorframe.operators import aggregates as A, asof, episodes as epi
from priorframe.queries.base import BULK, BULK_DAYS, EPISODES, LOG, bulk, bulk_days, episodes, log, query, r, read

VOCAB = {"swing": ("click", "purchase", "error"), "whiff": ("error",), "taken": ("view", "signup"), "called": ("signup",)}
VOCAB_WIDE = VOCAB | {"whiff": ("error", "click")}
FLAGS = """, f AS (SELECT *, CAST(kind IN ('click', 'purchase', 'error') AS INTEGER) AS swing, CAST(kind = 'error' AS INTEGER) AS whiff, CAST(kind IN ('view', 'signup') AS INTEGER) AS taken, CAST(kind = 'signup' AS INTEGER) AS called FROM log)"""


def flagged(spark, sf):
    return A.classify(log(spark, sf), "kind", VOCAB)


@query("classify_event", f"WITH {LOG}{FLAGS} SELECT event_id, swing, whiff, taken, called, CAST(kind IN ('error', 'click') AS INTEGER) AS whiff_wide FROM f")
def classify(spark, sf):
    wide = A.classify(flagged(spark, sf).withColumnRenamed("whiff", "w"), "kind", {"whiff_wide": VOCAB_WIDE["whiff"]})
    return wide.select("event_id", "swing", F.col("w").alias("whiff"), "taken", "called", "whiff_wide")


@query("collapse_units", f"""WITH {LOG} SELECT entity, day, arg_min(kind, event_id) AS first_kind, arg_max(kind, event_id) AS last_kind, arg_max(CASE WHEN k > 20 THEN k END, CASE WHEN k > 20 THEN event_id END) AS last_big, max(value) AS max_value, count(*) AS rows FROM log GROUP BY entity, day""")
def collapse(spark, sf):
    e = log(spark, sf).withColumn("big", F.when(F.col("k") > 20, F.col("k")))
    return epi.collapse_units(e, ["entity", "day"], F.col("event_id"), ["kind"], ["kind", "big"], ["value"]).select("entity", "day", "first_kind", "last_kind", "last_big", "max_value", "rows")


@query("entity_episode_counts", f"WITH {LOG}{FLAGS} SELECT entity, day, count(*) AS trials, CAST(sum(swing) AS BIGINT) AS swing, CAST(sum(whiff) AS BIGINT) AS whiff FROM f GROUP BY ALL")
def counts(spark, sf):
    return A.entity_counts(flagged(spark, sf), ["entity", "day"], ["swing", "whiff"])


@query("wide_conditional_scan", f"""WITH {BULK} SELECT 'entity' AS grouping, CAST(entity AS VARCHAR) AS key, count(*) AS rows, round(sum(quantity), 3) AS total, round(sum(price * price) / 1e6, 2) AS squares FROM bulk GROUP BY entity
  UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), count(*), round(sum(quantity), 3), round(sum(price * price) / 1e6, 2) FROM bulk GROUP BY slot
  UNION ALL SELECT 'epoch', CAST(epoch AS VARCHAR), count(*), round(sum(quantity), 3), round(sum(price * price) / 1e6, 2) FROM bulk GROUP BY epoch""")
def wide(spark, sf):
    tables = A.wide_scan(bulk(spark, sf), {k: [k] for k in ("entity", "slot", "epoch")}, ["quantity", "price"])
    parts = [t.select(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("key"), "rows", F.round("quantity_sum", 3).alias("total"), F.round(F.col("price_sq") / 1e6, 2).alias("squares")) for k, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("season_profile", f"""WITH {LOG}{FLAGS} SELECT entity, round(CASE WHEN count(*) > 0 THEN sum(whiff) / count(*)::DOUBLE ELSE 0 END, 6) AS swstr, round((sum(whiff) + sum(called)) / count(*)::DOUBLE, 6) AS csw, round(sum(success) / count(*)::DOUBLE, 6) AS k_rate,
  round(CASE WHEN sum(swing) > 0 THEN (sum(swing) - sum(whiff)) / sum(swing)::DOUBLE ELSE 0 END, 6) AS contact, round(CASE WHEN sum(CASE WHEN k > 60 THEN 1 END) > 0 THEN sum(CASE WHEN k > 60 THEN swing END) / sum(CASE WHEN k > 60 THEN 1 END)::DOUBLE ELSE 0 END, 6) AS chase FROM f GROUP BY entity""")
def profile(spark, sf):
    x = flagged(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("whiff").alias("w"), F.sum("called").alias("c"), F.sum("success").alias("s"), F.sum("swing").alias("sw"), A.count_when(F.col("k") > 60).alias("o"), F.sum(F.when(F.col("k") > 60, F.col("swing"))).alias("os"))
    rate = lambda a, b, name: F.round(safe_rate(a, b, 0.0), 6).alias(name)
    return x.select("entity", rate("w", "n", "swstr"), rate(F.col("w") + F.col("c"), "n", "csw"), rate("s", "n", "k_rate"), rate(F.col("sw") - F.col("w"), "sw", "contact"), rate("os", "o", "chase"))


@query("usage_mix", f"""WITH {LOG}{FLAGS}, g AS (SELECT entity, CASE WHEN k = 7 THEN NULL ELSE kind END AS kd, swing, whiff FROM f), b AS (SELECT entity, kd, count(*) AS n, sum(swing) AS a, sum(whiff) AS h FROM g GROUP BY ALL),
  u AS (SELECT *, n / sum(n) OVER (PARTITION BY entity)::DOUBLE AS usage, CASE WHEN a > 0 THEN h / a::DOUBLE ELSE 0 END AS rate FROM b)
  SELECT entity, CAST(count(*) FILTER (kd IS NOT NULL AND usage >= 0.1) AS BIGINT) AS breadth, round(sum(usage * rate) FILTER (kd IS NOT NULL), 6) AS weighted_rate, round(sum(usage) FILTER (kd = 'view'), 6) AS view_usage, CAST(count(*) FILTER (kd IS NOT NULL) AS INTEGER) AS kinds FROM u GROUP BY entity""")
def usage(spark, sf):
    e = flagged(spark, sf).withColumn("kd", F.when(F.col("k") != 7, F.col("kind")))
    m = A.usage_mix(e, "entity", "kd", F.col("swing") == 1, F.col("whiff") == 1)
    return m.select("entity", "breadth", r("weighted_rate"), F.round(F.try_element_at("mix", F.lit("view"))["usage"], 6).alias("view_usage"), F.size("mix").alias("kinds"))


@query("rate_by_split", f"""WITH {LOG} SELECT entity, round(CASE WHEN count(*) FILTER (k % 2 = 0) >= 20 THEN sum(success) FILTER (k % 2 = 0) / count(*) FILTER (k % 2 = 0)::DOUBLE END, 6) AS rate_l, round(CASE WHEN count(*) FILTER (k % 2 = 1) >= 20 THEN sum(success) FILTER (k % 2 = 1) / count(*) FILTER (k % 2 = 1)::DOUBLE END, 6) AS rate_r FROM log GROUP BY entity""")
def by_split(spark, sf):
    e = log(spark, sf).withColumn("hand", F.when(F.col("k") % 2 == 0, "L").otherwise("R"))
    x = A.rate_by_split(e, "entity", "hand", ["L", "R"], "success", 20)
    return x.select("entity", F.round("rate_L", 6).alias("rate_l"), F.round("rate_R", 6).alias("rate_r"))


@query("platoon_shrink", f"WITH {LOG}, a AS (SELECT entity, count(*) AS n, avg(success) AS p FROM log GROUP BY entity), b AS (SELECT entity, count(*) AS m, avg(success) AS q FROM log WHERE k % 2 = 0 GROUP BY entity) SELECT entity, round(m / (m + 60.0::DOUBLE) * q + (1 - m / (m + 60.0::DOUBLE)) * p, 6) AS rate FROM a JOIN b USING (entity)")
def platoon(spark, sf):
    e = log(spark, sf).groupBy("entity").agg(F.avg("success").alias("p"), F.sum(F.when(F.col("k") % 2 == 0, F.col("success"))).alias("s"), A.count_when(F.col("k") % 2 == 0).alias("m")).filter("m > 0")
    return e.select("entity", F.round(shrink_rate("s", "m", "p", 60), 6).alias("rate"))


@query("episode_totals", f"""WITH {LOG}, g AS (SELECT *, k % 2 AS side FROM log), st AS (SELECT day, side, arg_min(entity, event_id) AS starter FROM g GROUP BY ALL)
  SELECT g.day, g.side, g.entity, count(*) AS units, CAST(sum(success) AS BIGINT) AS successes, round(sum(value), 4) AS total, max(k) AS top FROM g JOIN st ON g.day = st.day AND g.side = st.side AND g.entity = st.starter GROUP BY ALL""")
def totals(spark, sf):
    e = log(spark, sf).withColumn("side", F.col("k") % 2)
    s = epi.starter(e, ["day", "side"], "entity", "event_id").withColumnRenamed("starter", "entity")
    return e.join(s, ["day", "side", "entity"]).groupBy("day", "side", "entity").agg(F.count(F.lit(1)).alias("units"), F.sum("success").cast("long").alias("successes"), F.round(F.sum("value"), 4).alias("total"), F.max("k").alias("top"))


@query("group_validation", f"WITH {EPISODES} SELECT CAST(count(*) AS BIGINT) AS groups, CAST(count(DISTINCT entity) AS BIGINT) AS entities, round(avg(CASE WHEN n = 3 THEN 1 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN n < 3 THEN 1 ELSE 0 END), 6) AS below, round(avg(CASE WHEN n > 3 THEN 1 ELSE 0 END), 6) AS above FROM ep")
def validation(spark, sf):
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return episodes(spark, sf).agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("entity").alias("entities"), share(F.col("n") == 3, "exact"), share(F.col("n") < 3, "below"), share(F.col("n") > 3, "above"))


@query("relief_load", f"""WITH {LOG}, t AS (SELECT *, entity % 8 AS team FROM log), st AS (SELECT team, day, arg_min(entity, event_id) AS f FROM t GROUP BY ALL)
  SELECT team, day, count(*) AS load, count(DISTINCT entity) AS actors FROM t JOIN st USING (team, day) WHERE entity <> f GROUP BY ALL""")
def relief(spark, sf):
    return A.relief_load(log(spark, sf).withColumn("team", F.col("entity") % 8), ["team"], "day", "entity", "event_id")


@query("lag_gap_calendar_join", f"""WITH {LOG}, t AS (SELECT entity % 8 AS team, day, count(*) AS n FROM log GROUP BY ALL) SELECT a.team, a.day, a.n, coalesce(b.n > 40, false) AS heavy_yesterday FROM t a LEFT JOIN t b ON a.team = b.team AND b.day = a.day - 1""")
def lag_gap(spark, sf):
    t = log(spark, sf).groupBy((F.col("entity") % 8).alias("team"), "day").agg(F.count(F.lit(1)).alias("n"))
    y = t.select("team", F.date_add("day", 1).alias("day"), (F.col("n") > 40).alias("h"))
    return t.join(y, ["team", "day"], "left").select("team", "day", "n", F.coalesce("h", F.lit(False)).alias("heavy_yesterday"))


@query("bullpen_2d_3d", f"""WITH {LOG}, t AS (SELECT entity % 8 AS team, day, entity, count(*) AS n FROM log GROUP BY ALL), s AS (SELECT team, day, sum(CASE WHEN n < 4 THEN n ELSE 0 END) AS load FROM t GROUP BY ALL)
  SELECT team, day, CAST(coalesce(sum(load) OVER a, 0) AS DOUBLE) AS two, CAST(coalesce(sum(load) OVER b, 0) AS DOUBLE) AS three, coalesce(sum(load) OVER b, 0) > 120 AS heavy FROM s WINDOW a AS (PARTITION BY team ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY team ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def bullpen(spark, sf):
    t = log(spark, sf).groupBy((F.col("entity") % 8).alias("team"), "day", "entity").agg(F.count(F.lit(1)).alias("n"))
    s = t.groupBy("team", "day").agg(F.sum(F.when(F.col("n") < 4, F.col("n")).otherwise(0)).cast("double").alias("load"))
    s = asof.calendar_window(asof.calendar_window(s, ["team"], "day", "load", 2, "two"), ["team"], "day", "load", 3, "three")
    return s.select("team", "day", "two", "three", (F.col("three") > 120).alias("heavy"))


@query("prior_season_summary", f"""WITH {BULK_DAYS}, big AS (SELECT * FROM bd WHERE n >= 2), t AS (SELECT entity, epoch, CAST(sum(n) AS BIGINT) AS total FROM bd GROUP BY ALL)
  SELECT t.entity, t.epoch, total, count(b.n) AS starts, round(avg(b.q), 5) AS mean, round(quantile_cont(b.q, 0.5), 5) AS median, round(quantile_cont(b.q, 0.25), 5) AS p25, round(quantile_cont(b.q, 0.1), 5) AS p10 FROM t LEFT JOIN big b ON t.entity = b.entity AND t.epoch = b.epoch GROUP BY ALL""")
def season_summary(spark, sf):
    d = bulk_days(spark, sf)
    t = d.groupBy("entity", "epoch").agg(F.sum("n").alias("total"))
    q = lambda p, name: F.round(F.percentile("q", p), 5).alias(name)
    b = d.filter("n >= 2").groupBy("entity", "epoch").agg(F.count("n").alias("starts"), F.round(F.avg("q"), 5).alias("mean"), q(0.5, "median"), q(0.25, "p25"), q(0.1, "p10"))
    return t.join(b, ["entity", "epoch"], "left").na.fill(0, ["starts"])


@query("tto_ratios", f"""WITH {LOG}, q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS seq FROM log), z AS (SELECT *, CASE WHEN seq <= 9 THEN 1 WHEN seq <= 18 THEN 2 WHEN seq <= 27 THEN 3 ELSE 4 END AS bucket FROM q),
  o AS (SELECT entity, avg(success) AS r FROM z GROUP BY entity HAVING count(*) >= 50 AND avg(success) > 0), c AS (SELECT entity, bucket, avg(success) AS c, count(*) AS w FROM z GROUP BY ALL HAVING count(*) >= 5)
  SELECT CAST(bucket AS INTEGER) AS bucket, round(sum(c / r * w) / sum(w), 6) AS ratio, CAST(sum(w) AS BIGINT) AS trials FROM c JOIN o USING (entity) GROUP BY bucket""")
def tto(spark, sf):
    e = epi.sequence_buckets(log(spark, sf), ["entity"], ["ts", "event_id"])
    return A.tto_ratios(e, "entity", "bucket", "success", 50, 5).select("bucket", r("ratio"), "trials")


@query("variance_decomposition", f"""WITH {BULK_DAYS}, x AS (SELECT entity, n, s, s / n::DOUBLE AS p FROM bd), g AS (SELECT avg(s) AS m, var_samp(s) AS v FROM x GROUP BY entity)
  SELECT round(avg(n * p * (1 - p)), 6) AS bernoulli, round(var_samp(p) * avg(n * n), 6) AS rate_part, round(var_samp(n) * avg(p) * avg(p), 6) AS count_part, round(2 * avg(n) * avg(p) * covar_samp(n, p), 6) AS covariance, round(var_samp(s), 6) AS empirical,
    (SELECT round(var_samp(m), 6) FROM g) AS between_part, (SELECT round(avg(v), 6) FROM g) AS within_part FROM x""")
def decomposition(spark, sf):
    x = A.variance_components(bulk_days(spark, sf), "entity", "n", "s")
    return x.select(r("bernoulli"), r("rate_part"), r("count_part"), r("covariance"), r("empirical"), F.round("between", 6).alias("between_part"), F.round("within", 6).alias("within_part"))


@query("ceiling", f"WITH {EPISODES}, x AS (SELECT v - avg(v) OVER (PARTITION BY entity) AS d, count(v) OVER (PARTITION BY entity) AS c FROM ep) SELECT count(*) AS n, round(sqrt(var_samp(d)), 5) AS sd, round(sqrt(var_samp(d)) * sqrt(2 / pi()), 5) AS mae FROM x WHERE c >= 20")
def ceiling(spark, sf):
    return A.ceiling(episodes(spark, sf), "entity", "v", 20).select("n", r("sd", 5), r("mae", 5))


HAZ = f"""{EPISODES}, st AS (SELECT entity, epoch, least(n, 8) AS k FROM ep), e AS (SELECT CAST(epoch AS VARCHAR) AS epoch, k FROM st UNION ALL SELECT 'ALL', k FROM st), c AS (SELECT epoch, k, count(*) AS stopped FROM e GROUP BY ALL),
  sp AS (SELECT epoch, unnest(range(0, 9)) AS k FROM (SELECT DISTINCT epoch FROM e)), j AS (SELECT epoch, CAST(sp.k AS INTEGER) AS k, coalesce(stopped, 0) AS stopped FROM sp LEFT JOIN c USING (epoch, k)),
  ar AS (SELECT *, CAST(sum(stopped) OVER (PARTITION BY epoch ORDER BY k DESC) AS BIGINT) AS at_risk FROM j)"""


@query("hazard_table", f"""WITH {HAZ} SELECT epoch, k, at_risk, CAST(stopped AS BIGINT) AS stopped, round(CASE WHEN at_risk > 0 THEN stopped / at_risk::DOUBLE END, 6) AS hazard,
  round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high
  FROM (SELECT *, nullif(at_risk, 0)::DOUBLE AS n, stopped / nullif(at_risk, 0)::DOUBLE AS p FROM ar)""")
def hazard(spark, sf):
    x = A.hazard_table(episodes(spark, sf).withColumn("n", F.col("n").cast("int")), "n", "epoch", 8)
    return x.select("epoch", "k", "at_risk", F.col("stopped").cast("long").alias("stopped"), r("hazard"), r("low"), r("high"))


@query("boundary_hazard", f"""WITH {EPISODES}, x AS (SELECT epoch, n, unnest(range(1, 4)) AS j FROM ep), t AS (SELECT epoch, j, count(*) AS n, count(*) FILTER (n = 2 * j) AS pulled FROM x WHERE n >= 2 * j GROUP BY ALL),
  b AS (SELECT a.*, c.n AS n0, c.pulled AS p0 FROM t a LEFT JOIN t c ON a.epoch = c.epoch + 1 AND a.j = c.j), d AS (SELECT *, (pulled + p0) / (n + n0)::DOUBLE AS pl FROM b), s AS (SELECT *, sqrt(pl * (1 - pl) * (1 / n::DOUBLE + 1 / n0::DOUBLE)) AS se FROM d)
  SELECT epoch, CAST(j AS INTEGER) AS j, CAST(n AS BIGINT) AS n, CAST(pulled AS BIGINT) AS pulled, round(pulled / n::DOUBLE, 6) AS rate, round(CASE WHEN se > 0 THEN (pulled / n::DOUBLE - p0 / n0::DOUBLE) / se END, 5) AS z FROM s""")
def boundary(spark, sf):
    return A.boundary_hazard(episodes(spark, sf), "n", "epoch", 3, 2).select("epoch", "j", "n", "pulled", r("rate"), r("z", 5))


@query("distribution_table", f"""WITH {EPISODES}, e AS (SELECT CAST(epoch AS VARCHAR) AS epoch, n FROM ep UNION ALL SELECT 'ALL', n FROM ep), sp AS (SELECT epoch, unnest(range(0, 11)) AS k FROM (SELECT DISTINCT epoch FROM e)), c AS (SELECT epoch, n AS k, count(*) AS c FROM e GROUP BY ALL),
  m AS (SELECT epoch, round(avg(n), 6) AS mean, round(stddev_samp(n), 5) AS sd, CAST(median(n) AS DOUBLE) AS median FROM e GROUP BY epoch) SELECT epoch, CAST(sp.k AS INTEGER) AS k, CAST(coalesce(c, 0) AS BIGINT) AS c, mean, sd, median FROM sp LEFT JOIN c USING (epoch, k) JOIN m USING (epoch)""")
def distribution(spark, sf):
    ep = episodes(spark, sf).select(F.col("epoch").cast("string").alias("epoch"), "n")
    e = ep.unionByName(ep.withColumn("epoch", F.lit("ALL")))
    stats = e.groupBy("epoch").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 5).alias("sd"), F.percentile("n", 0.5).alias("median"))
    spine = stats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    c = e.groupBy("epoch", F.col("n").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return spine.join(c, ["epoch", "k"], "left").select("epoch", "k", F.coalesce("c", F.lit(0).cast("long")).alias("c"), "mean", "sd", "median")


@query("partial_shape", f"""WITH {LOG}, t AS (SELECT kind, k % 3 AS rem, count(*) AS o FROM log GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY kind) * sum(o) OVER (PARTITION BY rem) / (sum(o) OVER ())::DOUBLE AS e FROM t)
  SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, CAST((count(DISTINCT kind) - 1) * (count(DISTINCT rem) - 1) AS BIGINT) AS dof FROM m""")
def partial_shape(spark, sf):
    t = log(spark, sf).groupBy("kind", (F.col("k") % 3).alias("rem")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols, total = t.groupBy("kind").agg(F.sum("o").alias("a")), t.groupBy("rem").agg(F.sum("o").alias("b")), t.agg(F.sum("o").alias("n"))
    m = t.join(rows, "kind").join(cols, "rem").crossJoin(total).withColumn("e", F.col("a") * F.col("b") / F.col("n"))
    return m.agg(F.round(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")), 6).alias("chi2"), ((F.countDistinct("kind") - 1) * (F.countDistinct("rem") - 1)).alias("dof"))


@query("mix_shift_decomposition", f"""WITH {BULK}, y AS (SELECT epoch, avg(CASE WHEN quantity < 10 THEN 1.0::DOUBLE ELSE 0 END) AS low, avg(price) FILTER (quantity < 10) AS ml, avg(price) FILTER (quantity >= 10) AS mh, avg(price) AS m FROM bulk GROUP BY epoch)
  SELECT a.epoch, round(a.m - b.m, 4) AS change, round((a.low - b.low) * (b.ml - b.mh), 4) AS mixture, round(a.low * (a.ml - b.ml), 4) AS within_low, round((1 - a.low) * (a.mh - b.mh), 4) AS within_high FROM y a JOIN y b ON a.epoch = b.epoch + 1""")
def mix_shift(spark, sf):
    low = F.col("quantity") < 10
    y = bulk(spark, sf).groupBy("epoch").agg(F.avg(low.cast("double")).alias("low"), F.avg(F.when(low, F.col("price"))).alias("ml"), F.avg(F.when(~low, F.col("price"))).alias("mh"), F.avg("price").alias("m"))
    b = y.select((F.col("epoch") + 1).alias("epoch"), *(F.col(c).alias(f"{c}0") for c in ("low", "ml", "mh", "m")))
    j = y.join(b, "epoch")
    x = F.col
    return j.select("epoch", F.round(x("m") - x("m0"), 4).alias("change"), F.round((x("low") - x("low0")) * (x("ml0") - x("mh0")), 4).alias("mixture"), F.round(x("low") * (x("ml") - x("ml0")), 4).alias("within_low"), F.round((1 - x("low")) * (x("mh") - x("mh0")), 4).alias("within_high"))


TEAM = f"""{LOG}{FLAGS}, d AS (SELECT entity % 10 AS team, day, count(*) AS n, sum(success) AS s FROM f GROUP BY ALL), lg AS (SELECT day, sum(n) AS n, sum(s) AS s FROM d GROUP BY day),
  pl AS (SELECT day, coalesce(sum(s) OVER w, 0) / nullif(sum(n) OVER w, 0)::DOUBLE AS q FROM lg WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  pt AS (SELECT team, day, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(s) OVER w, 0) AS ps, count(*) OVER w AS days FROM d WINDOW w AS (PARTITION BY team ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("team_rate_prior_day", f"WITH {TEAM} SELECT team, day, round(CASE WHEN days >= 5 THEN (ps + 200 * q) / (pn + 200) END, 6) AS rate FROM pt JOIN pl USING (day)")
def team_rate(spark, sf):
    d = log(spark, sf).groupBy((F.col("entity") % 10).alias("team"), "day").agg(F.count(F.lit(1)).alias("n"), F.sum("success").alias("s")).withColumn("d", F.lit(1).cast("long"))
    league = d.groupBy("day").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    pl = asof.prior_sums(league.withColumn("all", F.lit(1)), ["all"], ["day"], ["n", "s"]).select("day", safe_rate("prior_s", "prior_n").alias("q"))
    pt = asof.prior_sums(d, ["team"], ["day"], ["n", "s", "d"])
    return pt.join(pl, "day").select("team", "day", F.round(F.when(F.col("prior_d") >= 5, shrink_rate("prior_s", "prior_n", "q", 200)), 6).alias("rate"))


@query("catcher_framing", f"WITH {LOG}{FLAGS}, lg AS (SELECT avg(called) AS q FROM f WHERE k > 50 AND taken = 1) SELECT entity, round(avg(called) - max(q), 6) AS framing, count(*) AS n FROM f, lg WHERE k > 50 AND taken = 1 GROUP BY entity HAVING count(*) >= 10")
def framing(spark, sf):
    t = flagged(spark, sf).filter("k > 50 and taken = 1")
    return t.groupBy("entity").agg(F.avg("called").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 10").crossJoin(t.agg(F.avg("called").alias("q"))).select("entity", F.round(F.col("c") - F.col("q"), 6).alias("framing"), "n")


@query("csoe", f"""WITH {LOG}{FLAGS}, d AS (SELECT entity, epoch, day, k % 6 AS bin, sum(taken) AS t, sum(called) AS c FROM f GROUP BY ALL), fr AS (SELECT k % 6 AS bin, sum(called) / sum(taken)::DOUBLE AS p FROM f WHERE epoch <= 2 GROUP BY 1),
  sp AS (SELECT entity, epoch, day, unnest(range(0, 6)) AS bin FROM (SELECT DISTINCT entity, epoch, day FROM d)), j AS (SELECT sp.*, coalesce(t, 0) AS t, coalesce(c, 0) AS c FROM sp LEFT JOIN d USING (entity, epoch, day, bin)),
  pr AS (SELECT entity, epoch, day, bin, coalesce(sum(t) OVER w, 0) AS t, coalesce(sum(c) OVER w, 0) AS c FROM j WINDOW w AS (PARTITION BY entity, epoch, bin ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT entity, epoch, day, round(CASE WHEN sum(t) >= 2 THEN (sum(c) - sum(t * p)) / (sum(t) + 6) END, 6) AS csoe FROM pr LEFT JOIN fr USING (bin) GROUP BY ALL""")
def csoe(spark, sf):
    f = flagged(spark, sf).withColumn("bin", F.col("k") % 6)
    d = f.groupBy("entity", "epoch", "day", "bin").agg(F.sum("taken").alias("t"), F.sum("called").alias("c"))
    spine = f.select("entity", "epoch", "day").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(5))))
    j = spine.join(d, ["entity", "epoch", "day", "bin"], "left").na.fill(0, ["t", "c"])
    frozen = f.filter("epoch <= 2").groupBy("bin").agg((F.sum("called") / F.sum("taken")).alias("p"))
    return A.calls_over_expected(j, "entity", "epoch", ["day"], ["bin"], "t", "c", frozen, 6).select("entity", "epoch", "day", r("csoe"))


@query("weighted_cover_mean", f"WITH {LOG} SELECT entity, day, round(CASE WHEN sum(CASE WHEN k >= 40 THEN value END) / sum(value) >= 0.5 THEN sum(CASE WHEN k >= 40 THEN k * value END) / sum(CASE WHEN k >= 40 THEN value END) END, 6) AS mean FROM log GROUP BY ALL")
def cover_mean(spark, sf):
    e = log(spark, sf).withColumn("x", F.when(F.col("k") >= 40, F.col("k")))
    return A.weighted_cover_mean(e, ["entity", "day"], "x", "value", order=["event_id", "value", "k"]).select("entity", "day", r("mean"))


@query("mix_tvd", f"""WITH {LOG}, s AS (SELECT entity, kind, count(*) / sum(count(*)) OVER (PARTITION BY entity)::DOUBLE AS b FROM log GROUP BY entity, kind), n AS (SELECT entity, count(*) AS t FROM log WHERE day >= DATE '2024-01-20' GROUP BY entity),
  q AS (SELECT entity, kind, count(*) FILTER (k <> 5) / max(t)::DOUBLE AS a FROM log JOIN n USING (entity) WHERE day >= DATE '2024-01-20' GROUP BY entity, kind)
  SELECT entity, round(CASE WHEN sum(coalesce(a, 0)) >= 0.9 - 1e-9 THEN sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2 END, 6) AS tvd FROM s FULL JOIN q USING (entity, kind) GROUP BY entity""")
def tvd(spark, sf):
    e = log(spark, sf)
    share = lambda x, hit: x.groupBy("entity", "kind").agg(hit.alias("c"), F.count(F.lit(1)).alias("n")).select("entity", "kind", (F.col("c") / F.sum("n").over(Window.partitionBy("entity"))).alias("share"))
    recent = share(e.filter(F.col("day") >= F.lit("2024-01-20").cast("date")), A.count_when(F.col("k") != 5))
    return A.mix_tvd(recent, share(e, F.count(F.lit(1))), "entity", "kind", "share").select("entity", r("tvd"))


@query("leash", f"WITH {BULK_DAYS}, d AS (SELECT entity % 10 AS team, day, sum(q) / sum(n) AS per FROM bd GROUP BY ALL) SELECT team, day, round(avg(per) OVER (PARTITION BY team ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-7, 4) AS leash FROM d")
def leash(spark, sf):
    d = bulk_days(spark, sf).groupBy((F.col("entity") % 10).alias("team"), "day").agg((F.sum("q") / F.sum("n")).alias("per"))
    return asof.prior_mean_std(d, ["team"], ["day"], "per").select("team", "day", F.round(F.col("prior_mean") + 1e-7, 4).alias("leash"))


@query("batter_profile", f"""WITH {LOG}{FLAGS} SELECT k AS batter, round(avg(success), 6) AS k_rate, round(CASE WHEN sum(swing) >= 10 THEN (sum(swing) - sum(whiff)) / sum(swing)::DOUBLE END, 6) AS contact, round(CASE WHEN count(*) FILTER (value > 60) >= 10 THEN sum(swing) FILTER (value > 60) / count(*) FILTER (value > 60)::DOUBLE END, 6) AS chase FROM f GROUP BY k""")
def batter_profile(spark, sf):
    out = F.col("value") > 60
    x = flagged(spark, sf).groupBy(F.col("k").alias("batter")).agg(F.round(F.avg("success"), 6).alias("k_rate"), F.sum("swing").alias("s"), F.sum("whiff").alias("w"), A.count_when(out).alias("o"), F.sum(F.when(out, F.col("swing"))).alias("os"))
    return x.select("batter", "k_rate", F.round(gated_rate(F.col("s") - F.col("w"), "s", 10), 6).alias("contact"), F.round(gated_rate("os", "o", 10), 6).alias("chase"))


@query("team_on_base", f"WITH {LOG} SELECT entity % 10 AS team, day, CAST(count(*) FILTER (kind <> 'error') AS BIGINT) AS pa, CAST(count(*) FILTER (kind IN ('purchase', 'signup')) AS BIGINT) AS ob FROM log GROUP BY ALL")
def on_base(spark, sf):
    return log(spark, sf).groupBy((F.col("entity") % 10).alias("team"), "day").agg(A.count_when(F.col("kind") != "error").alias("pa"), A.count_when(F.col("kind").isin("purchase", "signup")).alias("ob"))


@query("naive_game_set", f"WITH {EPISODES}, t AS (SELECT entity, sum(s) / sum(n)::DOUBLE AS whole FROM ep GROUP BY entity) SELECT entity, day, round(whole, 6) AS leaky, round((coalesce(sum(s) OVER w, 0) + 14) / (coalesce(sum(n) OVER w, 0) + 70)::DOUBLE, 6) AS prior FROM ep JOIN t USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def naive_set(spark, sf):
    ep = episodes(spark, sf)
    whole = ep.groupBy("entity").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("leaky"))
    return asof.prior_sums(ep, ["entity"], ["day"], ["n", "s"]).join(whole, "entity").select("entity", "day", "leaky", F.round(shrink_rate("prior_s", "prior_n", 0.2, 70), 6).alias("prior"))
