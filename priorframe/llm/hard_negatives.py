"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are the best other rows of its label, and the negatives of a
positive are the best rows of other labels whose scores lie in a window below it. The
windows of an anchor overlap, but their upper limits cut the scores into disjoint
slots: slot 0 ends at the highest limit, the last one has no lower end. A combiner in
each task keeps the k best of every slot, tasks are merged slot by slot, and the best
k under the limit of slot j are the first k of slot j followed by those under slot
j + 1: one descending merge answers all windows. What is below a window's lower limit
then falls off its end.

Anchors are a stated query set and meet all rows in blocks: anchors come in chunks of
``CHUNK`` in the order of their ids, a chunk (at most CHUNK vectors and k limits each)
is broadcast, and every task scores its rows against it, some thousand at a time. A
chunk's result is a written table.

Edge cases: rows with a null id, label or vector or with a null or non-finite component
take no part; of rows that repeat an id the least (label, vector) counts; vectors of
different lengths are compared as if the shorter one went on with zeros, so an empty
vector scores 0; ties go to the smaller id; scores are exact and are clipped beyond
2**56; an anchor without positives or a positive without negatives has no rows; extra
columns are ignored, whatever their names; an empty table gives no rows. There are no
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorframe.llm.common import discard, materialize, table

CHUNK = 4096
#: Rows and anchors of one matrix product.
ROWS, ANCHORS = 2048, 512
LIMIT = 1 << 56
NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor long, slot int, score long, id long"


def usable(vectors: DataFrame, id_col: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, label, v (whole numbers as doubles): one row an id, every component finite."""

    def whole(x: Column) -> Column:
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # A minimum is combined before its shuffle: an id on a third of all rows is one row a task.
    rows = rows.groupBy("id").agg(F.min(F.struct("label", F.transform("v", whole).alias("v"))).alias("r"))
    return rows.select("id", "r.label", "r.v")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled with zeros."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b: exact, in whole numbers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -LIMIT, LIMIT).astype(np.int64)


class Slots:
    """The k best rows of each slot of each anchor of a chunk; limits descend, and NO_SCORE stands for none."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray, floor: np.ndarray, same_label: bool, k: int):
        self.ids, self.labels, self.vectors, self.limits, self.floor, self.same, self.k = ids, labels, vectors, limits, floor, same_label, k
        self.width = limits.shape[1]
        self.scores = np.full((len(ids) * self.width, k), NO_SCORE)
        self.found = np.full((len(ids) * self.width, k), NO_ID)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for r in range(0, len(ids), ROWS):
            for a in range(0, len(self.ids), ANCHORS):
                self._block(slice(a, a + ANCHORS), ids[r : r + ROWS], labels[r : r + ROWS], vectors[r : r + ROWS])

    def _block(self, part: slice, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        s = products(self.vectors[part], vectors)
        like = self.labels[part][:, None] == labels
        take = like & (self.ids[part][:, None] != ids) if self.same else ~like
        # No slot takes less than its k-th best, so a row of the matrix takes nothing below the least of them.
        kth = np.where(self.limits[part] > NO_SCORE, self.scores[:, -1].reshape(-1, self.width)[part], NO_ID).min(axis=1)
        take &= (s <= self.limits[part][:, :1]) & (s >= np.maximum(self.floor[part], kth)[:, None])
        a, r = np.nonzero(take)
        if not len(a):
            return
        s, i, a = s[a, r], ids[r], a + part.start
        slot = a * self.width + (self.limits[a] >= s[:, None]).sum(axis=1) - 1
        better = (s > self.scores[slot, -1]) | ((s == self.scores[slot, -1]) & (i < self.found[slot, -1]))
        s, i, slot = s[better], i[better], slot[better]
        old = np.unique(slot)
        s, i, slot = np.concatenate([s, self.scores[old].ravel()]), np.concatenate([i, self.found[old].ravel()]), np.concatenate([slot, np.repeat(old, self.k)])
        order = np.lexsort((i, -np.maximum(s, NO_SCORE + 1), slot))
        s, i, slot = s[order], i[order], slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.scores[slot[keep], place[keep]], self.found[slot[keep], place[keep]] = s[keep], i[keep]

    def batch(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.found != NO_ID)
        columns = [pa.array(self.ids[slot // self.width]), pa.array((slot % self.width).astype(np.int32)), pa.array(self.scores[slot, place]), pa.array(self.found[slot, place])]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "id"])


def best_of_slots(rows: DataFrame, anchors: list, limits: np.ndarray, floor: np.ndarray, same_label: bool, k: int) -> DataFrame:
    """anchor, slot, score, id: the k best rows of every slot of a chunk of anchors."""
    vectors = matrix(pa.array([list(r["v"]) for r in anchors], pa.list_(pa.float64())))
    chunk = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in anchors], np.int64), np.array([r["label"] for r in anchors], np.int64), vectors, limits, floor))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(*chunk.value, same_label, k)
        for batch in batches:
            slots.add(np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2)))
        yield slots.batch()

    found = rows.select("id", "label", "v").mapInArrow(combine, FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def suffix_merges(slots: str, width: int, k: int) -> Column:
    """For each slot, the k best entries of it and of all below; slots has structs (slot, down, id, score), in order."""
    kind = "array<struct<slot:int,down:bigint,id:bigint,score:bigint>>"
    below = lambda done: F.coalesce(F.get(done, F.lit(0)), F.array().cast(kind))
    own = lambda j: F.filter(F.col(slots), lambda e: e["slot"] == j)
    step = lambda done, j: F.concat(F.array(F.slice(F.concat(own(j), below(done)), 1, k)), done)
    return F.aggregate(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), F.array().cast(f"array<{kind}>"), step)


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
) -> DataFrame:
    """One row for each anchor, positive and negative, with scores and the negative's rank.

    is_anchor is a condition on the column ``id``. A negative's score is between low and high
    percent of the positive's. A score is the inner product of floor(scale * component).
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector, label, scale), "vectors")
    asked = materialize(rows.filter(is_anchor), "anchors")
    last, parts = None, []
    while anchors := (asked if last is None else asked.filter(F.col("id") > last)).orderBy("id").limit(CHUNK).collect():
        last = anchors[-1]["id"]
        parts.append(_of_chunk(rows, anchors, n_positives, n_negatives, low, high))
    discard(asked, rows)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


def _of_chunk(rows: DataFrame, anchors: list, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    open_end = np.full((len(anchors), 1), NO_ID)
    nearest = best_of_slots(rows, anchors, open_end, np.full(len(anchors), NO_SCORE), True, n_positives)
    limit = F.floor(F.col("score").cast("decimal(38,0)") * high / 100).cast("long")
    positives = materialize(nearest.select("anchor", F.col("id").alias("positive"), "score", "place", limit.alias("limit")), "positives")
    limits = np.full((len(anchors), n_positives), NO_SCORE)
    floor = np.full(len(anchors), NO_ID)
    at = {r["id"]: i for i, r in enumerate(anchors)}
    by: dict[int, set[int]] = {}
    for r in positives.select("anchor", "score", "limit").collect():  # n_positives an anchor
        i = at[r["anchor"]]
        by.setdefault(i, set()).add(r["limit"])
        floor[i] = min(floor[i], -(-low * r["score"] // 100))
    for i, own in by.items():
        limits[i, : len(own)] = sorted(own, reverse=True)
    found = best_of_slots(rows, anchors, limits, floor, False, n_negatives)
    slots = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("down"), "id", "score"))).alias("slots"))
    merged = slots.select("anchor", suffix_merges("slots", n_positives, n_negatives).alias("under"))
    slot = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("limit"))) - 1
    pairs = positives.select("anchor", "positive", F.col("score").alias("best"), slot.alias("slot")).join(merged, "anchor")
    inside = F.filter(F.get("under", F.col("slot")), lambda e: F.col("best") * low <= e["score"] * 100)
    hits = pairs.select("anchor", "positive", "best", F.posexplode(inside).alias("place", "e"))
    out = hits.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("e.id").alias("negative_id"), F.col("best").alias("positive_score"), F.col("e.score").alias("negative_score"),
    )
    out = materialize(out, "negatives")
    discard(positives)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


SQL_12 = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor, r.id, r.label = a.label AS alike, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE alike) WHERE place <= 5),
n AS (
  SELECT p.anchor, p.id AS positive, p.score AS best, s.id, s.score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(place AS INTEGER) AS rank, id AS negative_id,
  best AS positive_score, score AS negative_score
FROM n WHERE place <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
SQL = {"op12_hard_negatives": SQL_12}
