"""Bindings of the test tables to the roles of the operators, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under name, with its SQL if there is one. A name is given once."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log: entity, day, epoch (ISO week), kind, value, second entity k, success."""
    e = read(spark, sf, "events")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("entity"), F.to_date("ts").alias("day"), F.weekofyear("ts").cast("int").alias("epoch"), F.col("event_type").alias("kind"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_type") == "purchase").cast("int").alias("success"),
    )


LOG = """log AS (SELECT event_id, ts, user_id AS entity, CAST(ts AS DATE) AS day, CAST(weekofyear(ts) AS INTEGER) AS epoch,
    event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS success FROM events)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entity x day: trials, successes and the value sums of the day."""
    return log(spark, sf).groupBy("entity", "day", "epoch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("s"), F.sum("value").alias("v"), F.max("value").alias("top")
    )


EPISODES = LOG + """, ep AS (SELECT entity, day, epoch, count(*) AS n, CAST(sum(success) AS BIGINT) AS s, sum(value) AS v, max(value) AS top FROM log GROUP BY 1, 2, 3)"""


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a bulk log: supplier, day, year, success, quantity, price."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").alias("epoch"), (F.col("l_returnflag") == "R").cast("int").alias("success"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("item"),
    )


BULK = """bulk AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INTEGER) AS epoch,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS success, l_quantity AS quantity, l_extendedprice AS price,
    l_discount AS discount, l_linenumber AS slot, l_partkey AS item FROM lineitem)"""


def bulk_days(spark: SparkSession, sf: str) -> DataFrame:
    return bulk(spark, sf).groupBy("entity", "day", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("success").cast("long").alias("s"), F.sum("quantity").alias("q"), F.sum("price").alias("p"))


BULK_DAYS = BULK + """, bd AS (SELECT entity, day, epoch, count(*) AS n, CAST(sum(success) AS BIGINT) AS s, sum(quantity) AS q, sum(price) AS p FROM bulk GROUP BY 1, 2, 3)"""


def bets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a ledger of positions: grade, stake, American odds, model probability."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("strength")), "o_custkey")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("bet"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), "strength",
        F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSS").otherwise("PUSH").alias("grade"),
        F.ceil(F.col("o_totalprice") / 100000).cast("double").alias("stake"),
        F.when(digit <= 2, -100 - 20 * digit).otherwise(100 + 15 * digit).cast("int").alias("odds"),
        F.when(digit <= 2, 95 - 5 * digit).otherwise(-100 - 15 * digit).cast("int").alias("other_odds"),
        (F.lit(0.2) + F.pmod(F.col("o_orderkey") * 7919, F.lit(601)) / 1000.0).alias("prob"),
        F.col("o_totalprice").alias("price"),
    )


BETS = """bets AS (SELECT o_orderkey AS bet, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, c_mktsegment AS strength,
    CASE o_orderstatus WHEN 'F' THEN 'WIN' WHEN 'O' THEN 'LOSS' ELSE 'PUSH' END AS grade,
    CAST(ceil(o_totalprice / 100000) AS DOUBLE) AS stake,
    CAST(CASE WHEN d <= 2 THEN -100 - 20 * d ELSE 100 + 15 * d END AS INTEGER) AS odds,
    CAST(CASE WHEN d <= 2 THEN 95 - 5 * d ELSE -100 - 15 * d END AS INTEGER) AS other_odds,
    0.2::DOUBLE + (o_orderkey * 7919) % 601 / 1000.0::DOUBLE AS prob, o_totalprice AS price
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS d FROM orders) JOIN customer ON c_custkey = o_custkey)"""


def r(column: str, digits: int = 6):
    """A rounded double under its own name."""
    return F.round(F.col(column), digits).alias(column)
