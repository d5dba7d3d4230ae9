"""Mixing sources to target weights by cube-method balanced sampling.

Sources have weights; each takes its share of all words, but no more than ``cap``
times its own size, and what is cut goes to the others by weight. Within a source
every document is taken floor(rate) times, and once more with the probability of
the fraction. Those last draws are balanced: the flight phase of the cube method
moves the inclusion probabilities along the null space of two constraints, the
number of documents and the number of words, until each is 0 or 1 but for a few.

The flight runs in blocks of a source, each a few thousand documents dealt by hash,
so a hot source is many blocks. What a block can't decide (at most three units)
flies again with that of other blocks, level by level, until one block of a source
is left; its last 14 units land on the choice with the least deviation of words.
Documents much longer than the others are decided before, each against all smaller
ones at once, which keeps the words but not the number of documents.

The unit is a distinct (id, source, size): repeated rows share one decision, which
is a function of those values, so reruns agree and rows can be joined to it. Only
these narrow columns are shuffled.

Edge cases: a null or empty text has size 0, and takes nothing; a null source is a
source, ordered last; a null id is an id; extra columns are left alone; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.common import boxed, discard, materialize, n_words_of, table
from priorframe.llm.node_filter import maybe_among

WEIGHTS = (5, 2, 1)
BLOCK = 4000
MERGE = 500
EDGE = 1e-9
#: Units that a landing tries all choices of, and the size, in means, from which a unit is decided against all others.
LANDING = 14
GIANT = 4


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Columns source, source_size, n_units, target, from one row for each unit (source, size, n_rows).

    Sources are numbered by a distributed sort and the counts of its partitions. The
    level (target for a weight of one) rises until the sources whose limit it exceeds
    are the same twice; each step is one aggregate over the sources.
    """
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    numbered = materialize(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[k] for k in sorted(counts))])))
    base = F.create_map(*(F.lit(x) for k in before for x in (k, before[k])))[part] if before else F.lit(0)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((base + within) % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", "n_units", weight.alias("weight"), (cap * F.col("source_size")).alias("limit"))
    level, capped = math.inf, -1
    while True:
        full = F.col("limit") < level * F.col("weight") if level < math.inf else F.lit(False)
        left = F.when(full, F.lit(0.0))
        got = rows.agg(
            F.count_if(full).alias("capped"), (F.sum("source_size") - F.sum(F.when(full, F.col("limit")).otherwise(0.0))).alias("words"), F.sum(F.coalesce(left, F.col("weight"))).alias("weight"),
        ).first()
        if got["capped"] == capped or not got["weight"]:
            break
        level, capped = got["words"] / got["weight"], got["capped"]
    return rows.select("source", "source_size", "n_units", F.least(F.col("limit"), F.lit(level if level < math.inf else 0.0) * F.col("weight")).alias("target"))


def _null_vector(a: np.ndarray) -> np.ndarray:
    """A vector that both rows of a (2 x 3) are orthogonal to."""
    u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
    if np.abs(u).max() > EDGE:
        return u
    row = a[0] if np.abs(a[0]).max() > EDGE else a[1]  # the rows are parallel
    u = np.array([row[1], -row[0], 0.0])
    return u if np.abs(u).max() > EDGE else np.array([1.0, 0.0, 0.0])


def spread(x: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the giants: units of more than GIANT times the mean size, largest first.

    The null-space direction of a giant has all smaller open units against it, each in
    proportion to its room, so it ends at 0 or 1 while they stay open and the words stay
    the same. A giant that they can't outweigh is left to the flight.
    """
    x = x.copy()
    for g in np.argsort(-words, kind="stable"):
        open_ = np.flatnonzero((x > EDGE) & (x < 1 - EDGE))
        if not len(open_) or words[g] <= GIANT * words[open_].mean():
            break
        others = open_[(words[open_] <= words[g]) & (open_ != g)]
        if not EDGE < x[g] < 1 - EDGE or not len(others):
            continue
        room = np.minimum(x[others] / (1 - x[g]), (1 - x[others]) / x[g])
        mass = (words[others] * room).sum()
        if mass <= words[g]:
            continue
        step = -words[g] / mass * room
        move = 1 - x[g] if rng.random() < x[g] else -x[g]
        x[others] = np.clip(x[others] + move * step, 0, 1)
        x[g] = round(x[g] + move)
    return x


def flight(x: np.ndarray, totals: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move probabilities x (n) until at most leave (two or more) are between 0 and 1.

    totals (2 x n): sum(totals * x) of both rows stays. The expectation of each
    result is its probability. Large units go first, so that small ones are left.
    """
    x = x.astype(float).copy()
    size = totals[1]
    scale = np.abs(totals).max(axis=1, keepdims=True)
    totals = totals / np.where(scale > 0, scale, 1)
    open_ = np.flatnonzero((x > EDGE) & (x < 1 - EDGE))
    order = open_[np.argsort(-size[open_], kind="stable")]
    waiting, left = iter(order), len(order)
    active = list(itertools.islice(waiting, 3))
    while len(active) == 3 and left > leave:
        p, u = x[active], _null_vector(totals[:, active])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + up * u if rng.random() * (up + down) < down else p - down * u
        p[p < EDGE] = 0
        p[p > 1 - EDGE] = 1
        x[active] = p
        active = [i for i in active if 0 < x[i] < 1]
        left -= 3 - len(active)
        active += list(itertools.islice(waiting, 3 - len(active)))
    return x


def land(x: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Round the few units left to the choice that keeps the words nearest, then the documents."""
    x = x.copy()
    left = np.flatnonzero((x > EDGE) & (x < 1 - EDGE))
    x[x <= EDGE], x[x >= 1 - EDGE] = 0, 1
    if len(left):
        choice = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        documents, words = np.abs((choice - x[left]) @ totals[:, left].T).round(6).T
        x[left] = choice[np.lexsort((documents, words))[0]]
    return x


def _fly_block(last: bool, seed: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "size"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{key}".encode()))
        totals = np.stack([pdf["n_rows"].to_numpy(float), (pdf["size"] * pdf["n_rows"]).to_numpy(float)])
        x = spread(pdf["x"].to_numpy(float), totals[1], rng)
        pdf["x"] = land(flight(x, totals, rng, LANDING), totals) if last else flight(x, totals, rng)
        return pdf

    return run


def sample_copies(units: DataFrame, seed: int = 0, block: int = BLOCK, merge: int = MERGE) -> DataFrame:
    """units (id, source, size, n_rows, n_units, x) with x moved from probabilities to 0 or 1, balanced within sources."""
    spark = units.sparkSession
    units = units.withColumn("h", F.xxhash64(F.lit(seed), "id", "source", "size"))
    blocks = F.ceil(F.col("n_units") / block).cast("long")
    state = units.withColumn("block", F.pmod("h", blocks)).withColumn("blocks", blocks)
    done, level = [], 0
    while True:
        # One block of a source left: this flight is its last and ends in a landing.
        only, many = state.filter(F.col("blocks") == 1), state.filter(F.col("blocks") > 1)
        flown = materialize(
            only.groupBy("source", "block").applyInPandas(_fly_block(True, seed, level), state.schema)
            .unionByName(many.groupBy("source", "block").applyInPandas(_fly_block(False, seed, level), state.schema)),
            f"flight{level}",
        )
        open_ = (F.col("x") > 0) & (F.col("x") < 1)
        done.append(flown.filter(~open_))
        state = flown.filter(open_)
        if state.isEmpty():
            break
        blocks = F.ceil(F.col("blocks") / merge).cast("long")
        state = state.withColumn("block", F.floor(F.col("block") / merge)).withColumn("blocks", blocks)
        level += 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("h", "block", "blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """One row for each unit: id, source, size, n_rows, source_size, target and copies."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"))
    units = materialize(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "units")
    targets = materialize(source_targets(units, weights, cap), "targets")
    t = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.join(t, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("rate", rate)
    # A rate within rounding of a whole number is that number.
    whole = F.floor(F.col("rate") + EDGE)
    units = units.withColumn("whole", whole).withColumn("x", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    units = units.withColumn("x", F.when((F.col("x") < EDGE) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("x")))
    drawn = sample_copies(units, seed)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("x").cast("long")).otherwise(F.lit(0)).cast("long")
    return drawn.select("id", "source", "size", "n_rows", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs that the mix takes at least once, with the column mix_copies. Texts that it doesn't take are not shuffled."""
    choice = materialize(mix(docs, id_col, text, source, **options).filter("copies > 0").select("id", "source", "size", "copies"), "choice")
    key = F.xxhash64("id", "source", "size").alias("node")
    box = boxed(docs, F.col(id_col).alias("id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"), names=[c for c in docs.columns if c != "mix_copies"])
    taken = box.withColumn("node", key).filter(maybe_among(choice.select(key), "node"))
    c = choice.select(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "copies").hint("merge")
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    return taken.join(c, same).select("row.*", F.col("copies").alias("mix_copies"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix(table(spark, sf_dir, "documents"))
    rows = chosen.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


QUERIES = {"op7_source_mix": op7_source_mix}
SQL: dict[str, str] = {}
