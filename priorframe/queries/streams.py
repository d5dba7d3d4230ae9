"""Queries of the streaming operators, replayed in several triggers; their SQL is that of the whole table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorframe.queries.base import LOG, log, query
from priorframe.streaming import stateful as S

PIECES = 4
#: Rows of every tenth k arrive up to four days late; the log comes in pieces of days of arrival.
ARRIVALS = LOG + """, ar AS (SELECT *, day + CASE WHEN k % 10 = 0 THEN k // 10 % 5 ELSE 0 END AS arrival FROM log),
    width AS (SELECT min(arrival) AS lo, CAST(ceil((max(arrival) - min(arrival) + 1) / 4.0) AS INTEGER) AS w FROM ar),
    inbox AS (SELECT ar.*, CAST((arrival - lo) // w AS INTEGER) AS piece FROM ar, width)"""


def pieces(rows: DataFrame, arrival: str) -> list[DataFrame]:
    """Rows by the fourth of the days of arrival in which they come."""
    lo, hi = rows.agg(F.min(arrival), F.max(arrival)).first()
    width = -(-((hi - lo).days + 1) // PIECES) if lo else 1
    piece = F.floor(F.datediff(arrival, F.lit(lo)) / width)
    return [rows.filter(piece == i).drop(arrival) for i in range(PIECES)]


def late_log(spark, sf) -> DataFrame:
    late = F.when(F.col("k") % 10 == 0, F.floor(F.col("k") / 10).cast("int") % 5).otherwise(0)
    return log(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "day", F.date_add("day", late).alias("arrival"))


def settled_rows(spark, sf) -> DataFrame:
    """entity, slate (from noon to noon), actor, at, reason: each slate's cut-off is six in the morning of its second day."""
    e = log(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "entity", "k", "kind", F.col("day").alias("arrival"))
    e = e.withColumn("slate", F.to_date(F.col("ts") - F.expr("INTERVAL 12 HOURS"))).withColumn("cutoff", F.col("slate").cast("timestamp") + F.expr("INTERVAL 30 HOURS")).withColumn("ended", F.col("kind") == "signup")
    start = lambda stream, state: S.into_table(S.settle(stream, ["entity", "slate"], "k", "ts", "event_id", "ended", "cutoff", "2 hours"), state)
    state = S.replay(pieces(e, "arrival"), "settled", start)
    return spark.read.schema("entity long, slate date, actor long, at long, reason string").parquet(f"{state}-table")


SETTLED = f"""{LOG}, x AS (SELECT entity, CAST(ts - INTERVAL 12 HOUR AS DATE) AS slate, k AS actor, event_id AS id, epoch_us(ts) // 1000 AS tm, kind = 'signup' AS ended FROM log),
    y AS (SELECT *, epoch_ms(CAST(slate AS TIMESTAMP)) + 108000000 AS cutoff FROM x), z AS (SELECT * FROM y WHERE tm < cutoff),
    f AS (SELECT entity, slate, cutoff, actor, min(tm) AS tm, arg_min(id, (tm, id)) AS id FROM z GROUP BY ALL),
    t AS (SELECT entity, slate, min(tm) AS ended FROM z WHERE ended GROUP BY ALL),
    o AS (SELECT f.*, lead(tm) OVER (PARTITION BY f.entity, f.slate ORDER BY tm, id) AS relieved, CASE WHEN ended IS NOT NULL THEN greatest(tm, ended) END AS over_at FROM f LEFT JOIN t ON t.entity = f.entity AND t.slate = f.slate),
    s AS (SELECT entity, slate, actor, CASE WHEN relieved <= coalesce(over_at, relieved) THEN relieved ELSE coalesce(over_at, cutoff) END AS tm,
        CASE WHEN relieved <= coalesce(over_at, relieved) THEN 'relieved' WHEN over_at IS NOT NULL THEN 'terminal' ELSE 'expired' END AS reason FROM o),
    settled AS (SELECT * FROM s WHERE tm < (SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM log))"""


@query("settled_stream", f"WITH {SETTLED} SELECT entity, slate, actor, tm - epoch_ms(CAST(slate AS TIMESTAMP)) AS after_ms, reason FROM settled")
def settled_stream(spark, sf):
    return settled_rows(spark, sf).select("entity", "slate", "actor", (F.col("at") - F.unix_millis(F.col("slate").cast("timestamp"))).alias("after_ms"), "reason")


@query("carryover_stream", f"WITH {SETTLED} SELECT slate, count(DISTINCT entity) AS keys, count(*) AS settled, count(*) FILTER (reason = 'expired') AS expired, count(*) FILTER (tm >= epoch_ms(CAST(slate AS TIMESTAMP)) + 86400000) AS next_day FROM settled GROUP BY slate")
def carryover_stream(spark, sf):
    """By slate: keys that were settled, those that the cut-off closed, and those settled on the next day."""
    next_day = F.col("at") >= F.unix_millis(F.col("slate").cast("timestamp")) + 86_400_000
    return settled_rows(spark, sf).groupBy("slate").agg(F.count_distinct("entity").alias("keys"), F.count(F.lit(1)).alias("settled"), F.count_if(F.col("reason") == "expired").alias("expired"), F.count_if(next_day).alias("next_day"))


CLOCKS = f"""{ARRIVALS}, clocks AS (SELECT piece, max(max(ts)) OVER (ORDER BY piece) AS clock FROM inbox GROUP BY piece),
    judged AS (SELECT event_id, clock, ts < clock - INTERVAL 200 HOUR AS stale FROM inbox JOIN clocks USING (piece))"""


def fresh_rows(spark, sf) -> S.StaleRows:
    keep = S.StaleRows(spark, "ts", "200 HOURS")
    S.replay(pieces(late_log(spark, sf), "arrival"), "quotes", partial(S.into_batches, take=keep))
    return keep


@query("staleness_stream", f"WITH {CLOCKS} SELECT event_id FROM judged WHERE NOT stale")
def staleness_stream(spark, sf):
    return fresh_rows(spark, sf).rows().select("event_id")


@query("staleness_counts", f"WITH {CLOCKS} SELECT max(clock) AS clock, count(*) AS seen, count(*) FILTER (stale) AS dropped FROM judged")
def staleness_counts(spark, sf):
    return fresh_rows(spark, sf).counts.now().select(F.col("clock").cast("timestamp_ntz").alias("clock"), "seen", "dropped")


@query("late_days_stream", f"""WITH {ARRIVALS}, clocks AS (SELECT piece, max(max(day)) OVER (ORDER BY piece) AS clock FROM inbox GROUP BY piece),
    came AS (SELECT day, piece, count(*) AS n FROM inbox GROUP BY ALL),
    grid AS (SELECT d.day, c.piece, c.clock, coalesce(n, 0) AS n FROM (SELECT day, min(piece) AS first FROM came GROUP BY day) AS d JOIN clocks AS c ON c.piece >= d.first LEFT JOIN came ON came.day = d.day AND came.piece = c.piece),
    steps AS (SELECT *, coalesce(lag(clock - day >= 2) OVER (PARTITION BY day ORDER BY piece), false) AS was_final FROM grid)
  SELECT day, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (was_final), 0) AS BIGINT) AS late_rows, count(*) FILTER (was_final AND n > 0) AS reopened, count(*) FILTER (NOT was_final OR n > 0) AS reads, max(clock) - day >= 2 AS is_final
  FROM steps GROUP BY day""")
def late_days_stream(spark, sf):
    days = S.LateDays(spark, "day")
    S.replay(pieces(late_log(spark, sf), "arrival"), "log", partial(S.into_batches, take=days))
    return days.state.now()
