"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles with their counts. Darts are
thrown at the plane of each (element, unit of weight) by hashing, as a Poisson
process in the rank; a document sees those that land within its weights. Each dart
belongs to one of ``bands * rows`` coordinates, and the earliest of each coordinate
is the signature: two documents agree on a coordinate with the probability of their
weighted Jaccard similarity. Only as many darts are thrown as fill the coordinates,
about ``k ln k + 2k`` a document, whatever its size.

Signatures are joined in bands; candidates are verified exactly; components are the
classes (see linking.py). With the standard 30 bands of 5 rows a pair of similarity
0.8 is missed with probability 7e-6.

Equal texts are one node, so copies cost one row each. Words are those between
blanks; a text of fewer than five words is one shingle of them all.

Edge cases: texts without words (null, empty, blank) are never near copies; equal
ones are one class like other equal texts, null counting as empty. A null id is
never a class id unless the class has no other. Repeated rows are in one class, and
one of them stays where groups are reduced. Extra columns pass through; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm import textkit
from priorframe.llm.common import boxed, discard, materialize, table
from priorframe.llm.linking import link, units
from priorframe.llm.node_filter import maybe_among

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 30
ROWS = 5


def shingles_of(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams of all texts, and the text of each."""
    starts, ends, first = textkit.word_spans(buf, offsets, textkit.NOT_BLANK)
    words = textkit.span_hash(textkit.prefix_hash(buf), starts, ends)
    n = np.diff(first)
    text_of = np.repeat(np.arange(len(n)), n)
    grams = textkit.gram_hash(words, k)
    whole = text_of[: len(grams)] == text_of[k - 1 : k - 1 + len(grams)]
    short = [(d, textkit.gram_hash(words[first[d] : first[d + 1]], int(n[d]))[0]) for d in np.flatnonzero((n > 0) & (n < k))]
    texts = np.concatenate([text_of[: len(grams)][whole], np.array([d for d, _ in short], np.int64)])
    return np.concatenate([grams[whole], np.array([h for _, h in short], np.uint64)]), texts


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(hashes: np.ndarray, texts: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (m x k) of the texts that have elements, and which those are; texts are numbered below n."""
    element, owner = units(hashes, texts)
    weight = np.bincount(owner, minlength=n)
    which = np.flatnonzero(weight)
    row = np.zeros(n, np.int64)
    row[which] = np.arange(len(which))
    owner = row[owner]
    reach = (k * math.log(k) + 2 * k) / weight[which]
    rank = np.full(len(which) * k, np.inf)
    sign = np.zeros(len(which) * k, np.uint64)
    throw = np.zeros(len(element), np.uint64)
    step = np.uint64(0xA0761D6478BD642F)
    at = -np.log(uniform(textkit.mix(element + step)))
    while len(element):
        hit = np.flatnonzero(at < reach[owner])
        while len(hit):
            e, o, r, t = element[hit], owner[hit], at[hit], throw[hit]
            dart = textkit.mix(e ^ (t + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            slot = o * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(rank, slot, r)
            won = rank[slot] == r
            sign[slot[won]] = dart[won]
            throw[hit] = t + np.uint64(1)
            at[hit] = r - np.log(uniform(textkit.mix(e + (t + np.uint64(2)) * step)))
            hit = hit[at[hit] < reach[o]]
        missing = np.isinf(rank).reshape(-1, k).any(axis=1)
        if not missing.any():
            break
        reach[missing] *= 2
        keep = missing[owner]
        element, owner, throw, at = element[keep], owner[keep], throw[keep], at[keep]
    return sign.reshape(-1, k), which


def band_buckets(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band (m x bands)."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(textkit.BASE)
    for j in range(rows):
        out = textkit.mix(out + parts[:, :, j])
    return out


def signature_bands(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """nodes (node, text) to node, bucket: a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for first, past, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1))):
                hashes, texts = shingles_of(buf, offsets)
                signs, which = dart_signatures(hashes, texts, past - first, bands * rows)
                buckets = band_buckets(signs, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[first:past][which], bands)), pa.array(buckets.view(np.int64).ravel())], names=["node", "bucket"])

    return nodes.select("node", "text").mapInArrow(run, "node long, bucket long")


def text_node(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of the distinct texts (nodes) that have a class beside themselves.

    links: node, label; classes: label, class_id (least id of the class), class_docs.
    A text that no other row has, and none is near to, is in neither.
    """
    named = docs.select(F.col(id_col).alias("id"), text_node(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = materialize(signature_bands(named, bands, rows), "bands")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return named.select("node", "text").filter(maybe_among(nodes, "node")).join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])

    labels = link(buckets, texts_of, shingles_of, threshold)
    discard(buckets)
    stars = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    texts = named.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    known = texts.join(stars, "node", "left").filter("n > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known, "labelled")
    discard(labels)
    classes = materialize(known.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_docs")), "classes")
    return known.select("node", "label"), classes


def labelled(rows: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (node, id, ...) with class_id and class_docs; a row in no class is its own."""
    found = rows.join(links, "node", "left").join(classes, "label", "left")
    alone = F.col("label").isNull()
    return found.withColumn("class_id", F.when(alone, F.col("id")).otherwise(F.col("class_id"))).withColumn("class_docs", F.coalesce("class_docs", F.lit(1)))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with class_id and class_docs, which replace columns of those names."""
    names = [c for c in docs.columns if c not in ("class_id", "class_docs")]
    box = boxed(docs, text_node(text).alias("node"), F.col(id_col).alias("id"), names=names)
    return labelled(box, *near_duplicate_classes(docs, id_col, text, **options)).select("row.*", "class_id", "class_docs")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: that with the least id (of rows that repeat it, one).

    Only rows whose text is in a class of two or more rows are shuffled.
    """
    links, classes = near_duplicate_classes(docs, id_col, text, **options)
    box = boxed(docs, text_node(text).alias("node"), F.col(id_col).alias("id"))
    grouped = box.withColumn("maybe", maybe_among(links, "node"))
    alone = grouped.filter("not maybe").select("row.*")
    # The few that the filter can't tell have no label, and stay.
    maybe = grouped.filter("maybe").drop("maybe").join(links.hint("merge"), "node", "left").join(classes, "label", "left")
    chosen = maybe.filter(F.col("label").isNull() | F.col("id").eqNullSafe(F.col("class_id")))
    # Ids that stand twice in a class: rare, and only those rows are grouped.
    narrow = docs.select(text_node(text).alias("node"), F.col(id_col).alias("id")).join(links, "node").join(classes, "label").filter(F.col("id").eqNullSafe(F.col("class_id")))
    twice = materialize(narrow.groupBy("label").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("label"), "repeated")
    if twice.isEmpty():
        return alone.unionByName(chosen.select("row.*"))
    once = chosen.join(twice, "label", "left_anti").select("row.*")
    again = chosen.join(twice, "label", "left_semi").dropDuplicates(["label"]).select("row.*")
    return alone.unionByName(once).unionByName(again)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), text_node("text").alias("node"))
    return labelled(rows, *near_duplicate_classes(docs)).select(F.col("id").alias("doc_id"), "class_id", "class_docs")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
SQL: dict[str, str] = {}
