"""Line deduplication: exact copies and fuzzy ones, by MinHash over character shingles.

A line's set is its character 8-grams (ASCII letters in lower case). One permutation
fills the ``bands * rows`` coordinates of its signature: the hash of a shingle names
its coordinate and its value, and the least value stays; empty coordinates borrow
from others by a fixed probe sequence. Signatures are joined in bands, candidates
verified by exact Jaccard similarity, and components found by distributed
union-find (see linking.py). Of each component one occurrence stays: that in the
document with the least id, there the first. With 8 bands of 4 rows, a pair at the
threshold of 0.8 is found with probability 0.985, one at 0.9 with 0.9999.

A line is what stands between line feeds. Lines without a word (only blanks) are
never removed.

Edge cases: null and empty texts have no lines to remove, and stay as they are; a
line shorter than a shingle is one shingle, so only exact copies (but for case) are
linked to it; rows that repeat both id and text share one decision; a null id comes
last; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm import textkit
from priorframe.llm.common import BLANKS, boxed, discard, let, materialize, table
from priorframe.llm.linking import link
from priorframe.llm.node_filter import maybe_among, maybe_in, node_filter

SHINGLE = 8
THRESHOLD = 0.8
BANDS = 8
ROWS = 4
CHUNK = 1 << 18


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text and number of all lines that have a word."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 4
    begins = offsets[:-1][np.diff(offsets) > 0]
    mark = np.zeros(len(buf) + 1, bool)
    mark[1:] = buf == 10
    mark[begins] = True
    starts = np.flatnonzero(mark[:-1])
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(starts[1:], len(buf))
    keep = np.logical_or.reduceat(textkit.NOT_BLANK[buf], starts)
    ends = ends - (buf[ends - 1] == 10)
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[text])
    return starts[keep], ends[keep], text[keep], number[keep]


def char_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character k-grams of spans of UTF-8 bytes, in order and apart from each other, and the span of each.

    A span of fewer than k characters is one gram.
    """
    points = np.frombuffer(textkit.LOWER[buf].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) < len(buf):
        place = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        starts, ends = place[starts], place[ends]
    points += np.uint64(1)
    grams = textkit.gram_hash(points, k)
    n = ends - starts - k + 1
    short = np.flatnonzero(n <= 0)
    n = np.maximum(n, 0)
    # Marks where a span's grams begin and end, summed up, tell the grams that lie in a span.
    edge = np.zeros(len(grams) + 1, np.int8)
    long_ = n > 0
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, starts[long_] + n[long_], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    hashes, of = grams[inside], np.repeat(np.arange(len(n)), n)
    if not len(short):
        return hashes, of
    few = [textkit.gram_hash(points[starts[i] : ends[i]], int(ends[i] - starts[i]))[0] for i in short]
    return np.append(hashes, np.array(few, np.uint64)), np.append(of, short)


def line_shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of lines, one line after the other, and the line of each."""
    return char_grams(buf, offsets[:-1], offsets[1:])


def signatures(hashes: np.ndarray, of: np.ndarray, n: int, k: int) -> np.ndarray:
    """One-permutation MinHash signatures (n x k) of n sets that are not empty.

    The high half of a hash names the coordinate, the low half is the value.
    """
    empty = np.uint32(0xFFFFFFFF)
    sign = np.full(n * k, empty, np.uint32)
    coordinate = (((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sign, of * k + coordinate, hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    filled = sign.reshape(n, k)
    out = filled.copy()
    row, column = np.nonzero(out == empty)
    attempt = 0
    while len(row):
        # The same coordinate of two sets probes the same coordinates in the same order.
        probe = textkit.mix(np.arange(k, dtype=np.uint64) * np.uint64(textkit.BASE) + np.uint64(attempt)) % np.uint64(k)
        value = filled[row, probe.astype(np.int64)[column]]
        out[row, column] = value
        row, column = row[value == empty], column[value == empty]
        attempt += 1
    return out.astype(np.uint64)


def band_buckets(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sign.reshape(len(sign), bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(textkit.BASE)
    for j in range(rows):
        out = textkit.mix(out + parts[:, :, j])
    return out


def scan_lines(named: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc, text to doc, line_no, node, and buckets of the line (null on further occurrences within a chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for first, past, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1)), CHUNK):
                starts, ends, text, number = line_spans(buf, offsets)
                node = textkit.span_hash(textkit.prefix_hash(buf), starts, ends)
                _, once = np.unique(node, return_index=True)
                once.sort()
                buckets = np.zeros((0, bands), np.uint64)
                if len(once):
                    hashes, of = char_grams(buf, starts[once], ends[once])
                    buckets = band_buckets(signatures(hashes, of, len(once), bands * rows), bands, rows)
                size = np.zeros(len(node), np.int64)
                size[once] = bands
                mask = size == 0
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at, mask=np.append(mask, False)), pa.array(buckets.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(doc[first:past][text]), pa.array(number.astype(np.int32)), pa.array(node.view(np.int64)), listed], names=["doc", "line_no", "node", "buckets"])

    return named.select("doc", "text").mapInArrow(run, "doc long, line_no int, node long, buckets array<long>")


def line_texts(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc, text to node, text of the lines that are in nodes, and of a few others."""
    words = node_filter(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1)), CHUNK):
                starts, ends, _, _ = line_spans(buf, offsets)
                node = textkit.span_hash(textkit.prefix_hash(buf), starts, ends)
                node, once = np.unique(node.view(np.int64), return_index=True)
                maybe = maybe_in(words.value, node)
                node, once = node[maybe], once[maybe]
                yield pa.RecordBatch.from_arrays([pa.array(node), textkit.slices(buf, starts[once], ends[once])], names=["node", "text"])

    return named.select("doc", "text").mapInArrow(run, "node long, text string")


def doc_key(id_col: str, text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc (see doc_key) and removed, the numbers (from 0) of its lines that go, for documents that lose any."""
    named = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = materialize(scan_lines(named, bands, rows), "lines", dictionary=False)
    lines = scanned.select("doc", "line_no", "node")
    buckets = scanned.filter("buckets is not null").select("node", F.explode("buckets").alias("bucket"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return line_texts(named, nodes).join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])

    labels = link(buckets, texts_of, line_shingles, threshold, global_order=False, weighted=False)
    # Documents in the order of their ids; equal ids by their texts.
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("doc").alias("doc"))
    many = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    linked = labels.select("node", "label").unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    groups = materialize(many.join(linked, "node", "left").filter("n > 1 or label is not null").select("node", F.coalesce("label", "node").alias("label")), "groups")
    places = named.select("doc", order.alias("place")).dropDuplicates(["doc"])
    found = materialize(lines.join(groups, "node").select("doc", "line_no", "label").join(places, "doc"), "occurrences")
    discard(scanned, labels, groups)
    keeper = materialize(found.groupBy("label").agg(F.min(F.struct("place", "line_no")).alias("keep")), "keepers")
    gone = found.join(keeper, "label").filter((F.col("doc") != F.col("keep.place.doc")) | (F.col("line_no") != F.col("keep.line_no")))
    removed = materialize(gone.groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed")
    discard(found, keeper)
    return removed


def without_lines(text: F.Column, removed: F.Column) -> F.Column:
    """text without the lines of the given numbers (sorted, from 0): what lies between two that go stays, in one pass."""

    def between(lines: F.Column) -> F.Column:
        before, after = F.concat(F.array(F.lit(-1)), removed), F.concat(removed, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(before, after, lambda b, a: F.slice(lines, b + 2, a - b - 1))), "\n")

    return let(F.split(text, "\n", -1), between)


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """docs without their duplicate lines; documents of which no word is left go. A column n_chars follows the text.

    Only documents that lose a line are shuffled, to meet the numbers of those lines.
    """
    gone = duplicate_lines(docs, id_col, text, **options)
    box = boxed(docs, doc_key(id_col, text).alias("doc"), F.col(text).alias("text"))
    box = box.withColumn("maybe", maybe_among(gone.select(F.col("doc").alias("node")), "doc"))
    whole = box.filter("not maybe").select("row.*")
    met = box.filter("maybe").drop("maybe").join(gone.hint("merge"), "doc", "left")
    fields = {text: F.col("kept")}
    if n_chars in docs.columns:
        fields[n_chars] = F.char_length("kept").cast(docs.schema[n_chars].dataType)
    row = F.col("row")
    for name, value in fields.items():
        row = row.withField(f"`{name}`", value)
    cut = met.filter("removed is not null").select("row", without_lines(F.col("text"), F.col("removed")).alias("kept"))
    cut = cut.filter(F.translate("kept", " " + BLANKS, "") != "").select(row.alias("row"))
    return whole.unionByName(met.filter("removed is null").select("row.*")).unionByName(cut.select("row.*"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = duplicate_lines(docs)
    whole = F.coalesce(F.col("text"), F.lit(""))
    n_lines = F.when(whole == "", 0).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1)
    rows = docs.select("doc_id", doc_key("doc_id", "text").alias("doc"), n_lines.cast("long").alias("n_lines")).join(gone, "doc", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
