"""Streaming operators with keyed state, timers and clocks of their own.

``settle`` keeps one small state a group and lets rows out when their event time has
come. ``StaleRows`` and ``LateDays`` judge each trigger's rows against the clock that
the stream itself has reached, and keep what they have to remember as one small table a
trigger, so that a restarted or repeated trigger starts from the same state. ``replay``
feeds a table to a stream piece by piece; what comes out equals the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from priorframe.sources.work import work_dir

#: A bucket of groups: an Arrow table of first appearances.
STATE = "appearances binary"
FOREVER = 1 << 62


def settlements(actors: dict[int, tuple[int, int]], terminal: int | None) -> dict[int, tuple[int, str]]:
    """Actor -> (time, reason): when a later actor has appeared, or the group has ended; who has not appeared has not left."""
    order = sorted(actors, key=lambda a: actors[a])
    out = {}
    for i, actor in enumerate(order):
        options = []
        if i + 1 < len(order):
            options.append((actors[order[i + 1]][0], "relieved"))
        if terminal is not None:
            options.append((max(actors[actor][0], terminal), "terminal"))
        if options:
            out[actor] = min(options)
    return out


def settled_part(rows: pd.DataFrame, group: list[str], now: int) -> pd.DataFrame:
    """The first appearance of each actor of each group, in order within groups, with what settlements says of it.

    rows: group, actor, unknown (the actor is null), at, id, done, terminal (the time of an
    end, else FOREVER). Added are time (FOREVER: none yet), reason, and out: settled before now.
    """
    of = rows.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
    ends = np.full(of.max(initial=-1) + 1, FOREVER)
    np.minimum.at(ends, of, rows["terminal"].to_numpy(np.int64))
    actor, unknown, at, ids = (rows[c].to_numpy() for c in ("actor", "unknown", "at", "id"))
    order = np.lexsort((ids, at, actor, unknown, of))
    head = np.ones(len(order), bool)
    head[1:] = np.any([x[order][1:] != x[order][:-1] for x in (of, unknown, actor)], axis=0)
    heads = np.flatnonzero(head)
    done = np.logical_or.reduceat(rows["done"].to_numpy(bool)[order], heads)
    first = order[heads]
    turn = np.lexsort((ids[first], at[first], of[first]))
    first, done = first[turn], done[turn]
    found, of, at = rows.iloc[first].reset_index(drop=True), of[first], at[first]
    relieved = np.full(len(first), FOREVER)
    relieved[:-1] = np.where(of[1:] == of[:-1], at[1:], FOREVER)
    over = np.where(ends[of] < FOREVER, np.maximum(at, ends[of]), FOREVER)
    time = np.minimum(relieved, over)
    return found.assign(done=done, terminal=ends[of], time=time, reason=np.where(relieved <= over, "relieved", "terminal"), out=~done & (time < now))


def settle(rows: DataFrame, group: list[str], actor: str, event_time: str, id_col: str, terminal: str, cutoff: str, delay: str, buckets: int = 32) -> DataFrame:
    """One row for each actor of a group, when it is settled: a later actor has appeared, the group has ended, or its cut-off is over.

    rows is a stream. A group's state is each actor's first appearance and the first end;
    it is dropped at the cut-off (a column that is the same for all rows of a group), and
    later rows of the group are ignored. A row comes out once the watermark has passed its
    time, so no row that is late by less than delay can change what has come out, and
    the result is the same however the rows are split into triggers.

    Groups of one cut-off are dealt to buckets by hash; a bucket is one table of state, of
    which all groups are settled together. A bucket holds its share of the open groups.
    """
    plain = rows.withWatermark(event_time, delay).select(
        *group, F.pmod(F.hash(*group), F.lit(buckets)).alias("_bucket"), F.unix_millis(cutoff).alias("_cutoff"), F.coalesce(F.col(actor).cast("long"), F.lit(0)).alias("actor"), F.col(actor).isNull().alias("unknown"), F.col(event_time).alias("seen"),
        F.unix_millis(event_time).alias("at"), F.col(id_col).cast("long").alias("id"), F.lit(False).alias("done"), F.when(F.col(terminal), F.unix_millis(event_time)).otherwise(FOREVER).alias("terminal"),
    ).filter(F.col("at") < F.col("_cutoff"))
    keys = plain.select(*group).schema
    kept = [*group, "actor", "unknown", "at", "id", "done", "terminal"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, limit = state.getCurrentWatermarkMs(), int(key[1])
        tables = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        tables += [part[kept] for part in parts if len(part)]
        if not tables:
            return
        found = settled_part(pd.concat(tables, ignore_index=True), group, now)
        out = found[found["out"]].reset_index(drop=True)
        out["at"] = out["time"]
        if limit < now:
            rest = found[~found["out"] & ~found["done"]]
            out = pd.concat([out, rest.assign(at=limit, reason="expired")], ignore_index=True)
            state.remove()
        else:
            waiting = found.loc[~found["out"] & ~found["done"], "time"].min()
            table = pa.Table.from_pandas(found.assign(done=found["done"] | found["out"])[kept], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(limit if pd.isna(waiting) else min(int(waiting), limit), now))
        yield out[group].assign(actor=out["actor"].astype("Int64").mask(out["unknown"].astype(bool)), at=out["at"].astype("int64"), reason=out["reason"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", actor long, at long, reason string"
    return plain.groupBy("_bucket", "_cutoff").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Remembered:
    """A small table that each trigger reads as the one before left it, and writes anew: a repeated trigger finds the same."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def before(self, epoch: int) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{epoch - 1}")
        except AnalysisException:
            if epoch:
                raise
            return self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{epoch}")
        self.last = epoch

    def now(self) -> DataFrame:
        return self.before(self.last + 1)


class StaleRows:
    """Rows no older than a ceiling behind the stream's clock, which is the latest time it has seen; dropped rows are counted.

    A row is judged once, by its own time, when it comes: a fresh row does not make older
    ones beside it fresh, nor do old ones spoil it.
    """

    CLOCK = "clock timestamp, seen long, dropped long"

    def __init__(self, spark: SparkSession, time: str, ceiling: str):
        self.spark, self.time, self.ceiling = spark, time, ceiling
        self.folder = work_dir(spark, "fresh")
        self.counts = Remembered(spark, f"{self.folder}/counts", self.CLOCK)
        self.schema: str | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self.counts.before(epoch)
        clock = before.select("clock").unionByName(batch.select(F.max(self.time).alias("clock"))).agg(F.max("clock")).first()[0]
        stale = F.coalesce(F.col(self.time) < F.lit(clock) - F.expr(f"INTERVAL {self.ceiling}"), F.lit(True))
        told = Observation()
        kept = batch.observe(told, F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum(stale.cast("long")), F.lit(0)).alias("dropped")).filter(~stale)
        kept.write.mode("overwrite").parquet(f"{self.folder}/rows/epoch={epoch}")
        seen, dropped = told.get["seen"], told.get["dropped"]
        old = before.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
        self.counts.write(old.select(F.lit(clock).cast("timestamp").alias("clock"), (F.col("seen") + seen).alias("seen"), (F.col("dropped") + dropped).alias("dropped")), epoch)
        self.schema = batch.schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")


class LateDays:
    """Days of a stream: rows, whether the day is final, and how often late rows have opened it again.

    A day is final once the stream's clock (its latest day) is `days` days ahead and the
    day has rows. A row for a day that was final before its trigger is late: the day is
    read again. reads counts the triggers in which the day was open or opened again.
    """

    DAYS = "day date, rows long, late_rows long, reopened long, reads long, is_final boolean"

    def __init__(self, spark: SparkSession, day: str, days: int = 2):
        self.day, self.days = day, days
        self.state = Remembered(spark, f"{work_dir(spark, 'days')}/state", self.DAYS)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        came = batch.groupBy(F.col(self.day).alias("day")).agg(F.count(F.lit(1)).alias("came")).filter("day IS NOT NULL")
        # A table of days; the clock is one value of it.
        all_days = self.state.before(epoch).join(came, "day", "full")
        clock = all_days.agg(F.max("day")).first()[0]
        num = lambda c: F.coalesce(F.col(c), F.lit(0))
        was_final, n = F.coalesce(F.col("is_final"), F.lit(False)), num("came")
        late = was_final & (n > 0)
        out = all_days.select(
            "day", (num("rows") + n).alias("rows"), (num("late_rows") + F.when(late, n).otherwise(0)).alias("late_rows"), (num("reopened") + late.cast("long")).alias("reopened"),
            (num("reads") + (~was_final | late).cast("long")).alias("reads"), ((F.datediff(F.lit(clock), "day") >= self.days) & (num("rows") + n > 0)).alias("is_final"),
        )
        self.state.write(out, epoch)


def replay(pieces: list[DataFrame], name: str, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Write the pieces to a folder one after the other, and let the stream that start makes of it run to the end after each.

    start gets the stream and the folder of its checkpoint, which is returned.
    """
    spark = pieces[0].sparkSession
    folder = work_dir(spark, name)
    for piece in pieces:
        piece.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(pieces[0].schema).parquet(f"{folder}/in"), f"{folder}/state").awaitTermination()
    return f"{folder}/state"


def into_table(stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run a stream to its end into a table beside its checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", f"{checkpoint}-table").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_batches(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a stream to its end, a trigger's rows at a time into take(rows, epoch)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
