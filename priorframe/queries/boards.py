"""Queries of the daily board: gates and scores with SQL, and the ledger rows that come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorframe.operators import asof
from priorframe.plans import board as B
from priorframe.queries.base import EPISODES, episodes, log, query
from priorframe.queries.candidates import steady

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LEAST_GAMES, LEAST_MEAN, CEILING = 3, 1.5, 12.0

BOARD = f"""{EPISODES}, q AS (SELECT day, entity, arg_max(event_id, (ts, event_id)) AS quote, arg_max(k, (ts, event_id)) AS k, max(ts) AS ts FROM log WHERE kind IN ('view', 'click') AND ts <= day + INTERVAL 18 HOUR GROUP BY ALL),
  h AS (SELECT entity, day, count(*) OVER w AS games, avg(n) OVER w AS mean, coalesce(sum(n) OVER w, 0) AS trials, coalesce(sum(s) OVER w, 0) AS hits FROM ep WINDOW w AS (PARTITION BY entity ORDER BY day {PRIOR})),
  g AS (SELECT q.day, q.entity, quote, k, (k % 3) + 0.5::DOUBLE AS line, 100 + k AS over_odds, -110 - k AS under_odds, q.entity % 4 <> 0 AS confirmed, mean, trials, hits,
    CASE WHEN epoch_us(day + INTERVAL 18 HOUR) - epoch_us(ts) > 43200000000 THEN 'stale_quote' WHEN q.entity % 11 = 0 THEN 'not_scheduled' WHEN q.entity % 13 = 0 THEN 'not_regular' WHEN games < {LEAST_GAMES} THEN 'few_appearances' WHEN mean < {LEAST_MEAN} THEN 'short_outings' END AS reason FROM q JOIN h USING (entity, day)),
  e AS (SELECT *, mean * (hits + 20 * 0.2::DOUBLE) / (trials + 20) AS expected FROM g),
  o AS (SELECT *, {1 / B.DISPERSION}::DOUBLE AS size FROM e),
  p AS (SELECT *, 1 - list_sum([exp(lgamma(i + size) - lgamma(size) - lgamma(i + 1) + size * ln(size / (size + expected)) + i * ln(expected / (size + expected))) for i in range(0, CAST(floor(line) AS INTEGER) + 1)]) AS p_over FROM o)"""


def scores(spark, sf):
    e, ep = log(spark, sf), episodes(spark, sf)
    start = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")
    quotes = e.filter("kind IN ('view', 'click')").select("day", "entity", F.col("event_id").alias("quote"), "k", F.col("ts").cast("timestamp_ntz").alias("ts"), start.alias("start"))
    last = B.latest_quotes(quotes, "ts", "start", CEILING).withColumn("line", F.col("k") % 3 + 0.5).withColumn("over", 100 + F.col("k")).withColumn("under", -110 - F.col("k"))
    schedule = ep.filter("entity % 11 <> 0").select("day", "entity", (F.col("entity") % 4 != 0).alias("confirmed"), (F.col("entity") % 13 != 0).alias("regular"))
    known = asof.prior_sums(ep.withColumn("one", F.lit(1).cast("long")), ["entity"], ["day"], ["n", "s", "one"])
    state = known.select("day", "entity", F.col("prior_one").alias("games"), (F.col("prior_n") / F.nullif(F.col("prior_one"), F.lit(0))).alias("mean"), F.col("prior_n").alias("trials"), F.col("prior_s").alias("hits"))
    return B.scored(B.gated(last, schedule, state, LEAST_GAMES, LEAST_MEAN), "line", F.lit(0.2), 20.0)


@query("board_scores", f"WITH {BOARD} SELECT day, entity, quote, line, reason, CASE WHEN reason IS NULL THEN round(expected + 1e-9, 6) END AS expected, CASE WHEN reason IS NULL THEN round(p_over + 1e-9, 6) END AS p_over FROM p")
def board_scores(spark, sf):
    """Every quote of the board with the gate that stops it, or its expected count and probability of going over."""
    x = scores(spark, sf)
    scored = F.col("reason").isNull()
    return x.withColumn("expected", F.when(scored, F.col("expected"))).withColumn("p_over", F.when(scored, F.col("p_over"))).select("day", "entity", "quote", "line", "reason", steady("expected"), steady("p_over"))


@query("board_ledger")
def board_ledger(spark, sf):
    """Ledger rows of the whole board: primary plays, rungs of the ladder, what was stopped and why, units under the daily cap."""
    rungs = log(spark, sf).filter("kind = 'error'").groupBy("day", "entity", (F.col("k") % 6 + 1).alias("milestone")).agg((F.min("k") + 120).alias("odds"))
    out = B.board(scores(spark, sf), rungs, "line", "over", "under")
    return out.select("day", "entity", "kind", "at", "side", "odds", steady("prob"), steady("fair"), steady("edge"), "status", "stake", "units", "capped")
