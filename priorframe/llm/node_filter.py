"""Semi-join reduction by a Bloom filter of bounded size.

What a decision touches is often a small part of all rows. Before rows are shuffled to
meet it, each task sets those apart that it surely doesn't touch. The filter never misses a
row that is touched, so the join after it stays exact; it has at most ``MAX_BITS`` bits (16
MB), whatever the number of nodes: beyond about ten million it only sets less apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 27


def node_filter(nodes: DataFrame) -> Broadcast:
    """Broadcast bit words of the column node of nodes (64-bit hashes)."""
    n = nodes.count()
    bits = max(10, min(MAX_BITS, math.ceil(math.log2(16 * n + 1))))
    mask = F.lit((1 << bits) - 1).cast("long")
    node = F.col("node")
    places = nodes.select(F.explode(F.array(node.bitwiseAND(mask), F.shiftrightunsigned(node, 64 - bits))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 AS int))")
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return nodes.sparkSession.sparkContext.broadcast(table)


def maybe_in(table: np.ndarray, node: np.ndarray) -> np.ndarray:
    """False where node is surely not in the filter."""
    bits = int(math.log2(len(table))) + 6
    low = node & np.int64((1 << bits) - 1)
    high = (node.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    hit = lambda p: (table[p >> 6] >> (p & 63)) & 1
    return (hit(low) & hit(high)).astype(bool)


def maybe_among(nodes: DataFrame, column: str) -> Column:
    """Whether a column of 64-bit hashes may be in nodes: false only where it is surely not.

    Only that column goes through Python; the rows stay where they are.
    """
    words = node_filter(nodes)

    @F.arrow_udf("boolean")
    def probe(values: pa.Array) -> pa.Array:
        return pa.array(maybe_in(words.value, values.to_numpy(zero_copy_only=False)))

    return probe(F.col(column))
