"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the word definition used throughout: space and U+0009..U+000D.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir where it is set.

    Unset, a local session gets a temporary folder and a cluster the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            root = tempfile.mkdtemp(prefix="spark-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage. Columns of hashes need no dictionary."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of materialized frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame, *more: Column, names: list[str] | None = None) -> DataFrame:
    """Whole rows (or the columns names) in the one column row, and what an operator adds beside it: no name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if names is None else names))).alias("row"), *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(flat, " "), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def repartition_input(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
