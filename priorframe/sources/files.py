"""Scans with explicit schemas, snapshot choice, nested documents, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def normalize_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]], types: dict[str, str] | None = None) -> DataFrame:
    """df with each column of aliases under its own name and type; an error names all that no spelling gives."""
    found, missing = {}, []
    for name, spellings in aliases.items():
        hit = next((s for s in (name, *spellings) if s in df.columns), None)
        if hit is None:
            missing.append(name)
        else:
            found[name] = hit
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    types = types or {}
    return df.select(*((F.col(h).cast(types[n]) if n in types else F.col(h)).alias(n) for n, h in found.items()))


def scan_log(spark: SparkSession, path: str, schema: T.StructType, day: str, first: str, last: str, keep: Column | None = None) -> DataFrame:
    """Rows of the days from first to last. The schema is given, so that empty files can't change it; filters reach the scan."""
    rows = spark.read.schema(schema).parquet(path).filter(F.col(day).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
    return rows if keep is None else rows.filter(keep)


def scan_csv_captures(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All captures that match, with the file and the date in its name."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(pattern).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("file_date", F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def snapshot_select(rows: DataFrame, file: str, date: str, stamp: str, rank: Column) -> DataFrame:
    """Rows of the best file: newest date, then newest stamp inside, then least rank. Modification times are not looked at."""
    files = rows.groupBy(file).agg(F.max(date).alias("_d"), F.max(stamp).alias("_s"), F.min(rank).alias("_r"))
    best = files.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc_nulls_last("_d"), F.desc_nulls_last("_s"), "_r", file))).filter("_rn = 1").select(file)
    return rows.join(F.broadcast(best), file, "left_semi")


BOARD = "struct<events:array<struct<id:string,start:string,teams:array<struct<role:string,abbr:string>>>>,markets:array<struct<id:string,event:string,name:string>>,selections:array<struct<market:string,label:string,points:double,odds:string>>>"


def explode_board(boards: DataFrame, column: str, suffix: str, milestones: bool = False) -> DataFrame:
    """Rows of a market document: events, markets and selections joined on their ids.

    Two-sided markets give one row for each entity and line with both prices;
    milestones give one for each entity and label such as "6+". The entity is the
    market's name without its suffix.
    """
    doc = boards.select(F.from_json(column, BOARD).alias("d"))
    # Documents of parts of a day each hold its event.
    event = doc.select(F.explode("d.events").alias("e")).select(F.col("e.id").alias("event"), F.col("e.start").alias("start"), F.try_element_at(F.filter("e.teams", lambda t: t["role"] == "home"), F.lit(1))["abbr"].alias("home")).distinct()
    market = doc.select(F.explode("d.markets").alias("m")).select(F.col("m.id").alias("market"), F.col("m.event").alias("event"), F.trim(F.regexp_replace(F.col("m.name"), F.lit(suffix + "$"), F.lit(""))).alias("entity"))
    chosen = doc.select(F.explode("d.selections").alias("s")).select("s.market", "s.label", "s.points", "s.odds")
    rows = chosen.join(market, "market").join(event, "event", "left")
    if milestones:
        rows = rows.withColumn("milestone", F.regexp_extract("label", r"^(\d+)\+$", 1).try_cast("int")).filter("milestone is not null")
        return rows.select("event", "entity", "home", "start", "milestone", "odds")
    side = lambda x: F.max(F.when(F.col("label") == x, F.col("odds")))
    return rows.groupBy("event", "market", "entity", "home", "start", F.col("points").alias("line")).agg(side("Over").alias("over_odds"), side("Under").alias("under_odds"))


SLATE = "struct<date:date,generated_at:timestamp,reconstructed:boolean,pitchers:array<struct<pitcher_id:bigint,line:double,over_odds:int,under_odds:int,expected:double,ladder:array<struct<milestone:int,odds:int,units:double>>>>>"


def flatten_slate(slates: DataFrame, column: str) -> DataFrame:
    """One row for each rung, entities without rungs and slates without entities once."""
    s = slates.select(F.from_json(column, SLATE).alias("s")).select("s.date", "s.reconstructed", F.explode_outer("s.pitchers").alias("p"))
    return s.select("date", "reconstructed", "p.pitcher_id", "p.line", "p.expected", F.explode_outer("p.ladder").alias("r")).select("date", "reconstructed", "pitcher_id", "line", "expected", "r.milestone", "r.odds", "r.units")


#: Documents of a day.
SLATE_PARTS = 64


def slate_part(entity: str) -> Column:
    """The part of a day that an entity's documents are in: no document holds a whole day."""
    return F.pmod(F.xxhash64(entity), F.lit(SLATE_PARTS)).cast("int")


def nest_slate(rows: DataFrame, day: str, entity: str, values: list[str], rung: list[str]) -> DataFrame:
    """JSON documents of the parts (see slate_part) of each day: their entities, each with its rungs in order."""
    rungs = rows.groupBy(day, entity, *values).agg(F.sort_array(F.collect_list(F.when(F.col(rung[0]).isNotNull(), F.struct(*rung)))).alias("ladder"))
    return rungs.groupBy(day, slate_part(entity).alias("part")).agg(F.to_json(F.struct(F.col(day), F.sort_array(F.collect_list(F.struct(entity, *values, "ladder"))).alias("pitchers"))).alias("document"))


CONTEXT = "struct<game:bigint,date:date,home:struct<id:int,lineup:array<bigint>>,away:struct<id:int,lineup:array<bigint>>>"


def game_context(records: DataFrame, column: str) -> DataFrame:
    """One row for each batter of a lineup with its order, and the game's context; lineup_source tells whether it is confirmed."""
    g = records.select(F.from_json(column, CONTEXT).alias("g")).select("g.*")
    source = F.when((F.size("home.lineup") > 0) & (F.size("away.lineup") > 0), "confirmed").otherwise("projected")
    flat = g.select("game", "date", F.col("home.id").alias("home_id"), F.col("away.id").alias("away_id"), source.alias("lineup_source"), F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home.lineup").alias("l")), F.struct(F.lit("away").alias("side"), F.col("away.lineup").alias("l")))).alias("x"))
    return flat.select("game", "date", "home_id", "away_id", "lineup_source", "x.side", F.posexplode_outer("x.l").alias("pos", "batter")).withColumn("pos", F.col("pos") + 1)


def crosswalk(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a whole number for a key, the key typed, one row a key (that with the least values)."""
    typed = rows.withColumn(key, F.col(key).try_cast("bigint")).filter(F.col(key).isNotNull())
    return typed.groupBy(key).agg(*(F.min_by(c, F.struct(*columns)).alias(c) for c in columns))


def append_capture(rows: DataFrame, stamp: str, path: str, column: str = "captured_at") -> DataFrame:
    """Append rows with the shared stamp where they have none of their own; returns what was written."""
    own = F.col(column) if column in rows.columns else F.lit(None)
    out = rows.withColumn(column, F.coalesce(own, F.lit(stamp).cast("timestamp")))
    out.write.mode("append").parquet(path)
    return out


def sink_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
