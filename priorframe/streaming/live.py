"""Structured Streaming forms of the stateful operators.

Each runs over whatever files a source has (``availableNow``), keeps its checkpoint and
its result in a folder that driver and executors share, and returns the result. A
replay of a batch gives what the batch operator gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.sources.work import work_dir


def stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the Parquet file or folder at path, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    # A pattern that matches the path alone: a stream takes a single file only from a pattern.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


def run_complete(result: DataFrame, name: str, mode: str = "complete", shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run a streaming aggregate to the end of its input; the last complete table is the result."""
    spark = result.sparkSession
    folder = work_dir(spark, name)
    out = f"{folder}/table"

    def write(batch: DataFrame, epoch: int) -> None:
        shape(batch).write.mode("overwrite").parquet(out)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def run_append(result: DataFrame, name: str) -> DataFrame:
    """Run a stream into a Parquet sink to the end of its input."""
    spark = result.sparkSession
    folder = work_dir(spark, name)
    query = result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/table")


def latest_state(rows: DataFrame, keys: list[str], seq: str, values: list[str], final: str) -> DataFrame:
    """Latest values of each key; a key once final stays final, and no key is dropped."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col(final), F.col(seq))).alias("_s"), F.bool_or(final).alias("final"), F.count(F.lit(1)).alias("polls")).select(*keys, "_s.*", "final", "polls")


def closing_lines(rows: DataFrame, keys: list[str], captured: str, start: str, price: str) -> DataFrame:
    """Last price captured up to the start, by key."""
    return rows.filter(F.col(captured) <= F.col(start)).groupBy(*keys).agg(F.max_by(price, captured).alias("close"), F.max(captured).alias("at"))
