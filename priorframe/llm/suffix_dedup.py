"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

The suffixes that matter are the starts of strings of LENGTH bytes. They are put in
buckets block by block, and a bucket is settled from the ranks of sampled positions
before single suffixes are looked at, so that memory is that of a few texts and no
bucket is ever gathered:

1. A start's anchor is the least hash of the byte 64-grams in its next LENGTH bytes.
   Equal strings have equal anchors; the anchor's hash is the bucket. Consecutive
   starts with one anchor are a run, and a run's context is all bytes it reaches.
   Runs whose context occurs twice are repeated whole; a bucket with one run is not
   repeated at all. Counting does both.
2. The other runs (edges of repeats) are cut at a cover of sample positions every
   BLOCK bytes from the anchor. A block's rank is the hash of all bytes its starts
   reach, its core rank that of the bytes they share. A rank that occurs twice means
   that all its starts are repeated, a core rank that occurs once that none is.
3. What is left, a few starts at the edges, is compared string by string.

All three are hash aggregations, which pre-aggregate hot values on the map side. A
cover of fixed residues (a difference cover proper) needs the suffixes of a bucket
in one sorted list; here positions are aligned by content, through the anchor, so
that equality of ranks replaces the order of a list. See the README.

Texts are nodes by content: copies are counted, and worked on once. Strings are
told apart by 64-bit hashes.

Edge cases: null is the empty text; a text of fewer than LENGTH bytes loses nothing;
repeated rows are texts of their own, so a repeated long text goes whole; very long
texts are worked on in segments; extra columns are left alone; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm import textkit
from priorframe.llm.common import discard, materialize, table

LENGTH = 400
GRAM = 64
BLOCK = 16
SEGMENT = 1 << 20


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor: text, at (first start in its text), n (starts), lead (from it to the anchor), bucket, context."""
    names = ("text", "at", "n", "lead", "bucket", "context")
    if len(buf) < length:
        return {c: np.zeros(0, np.int64) for c in names}
    prefix = textkit.prefix_hash(buf)
    at = np.arange(len(buf) - gram + 1)
    hashes = textkit.span_hash(prefix, at, at + gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (textkit.sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    starts = np.flatnonzero(at[: len(anchor)] + length <= offsets[1:][text])
    if not len(starts):
        return {c: np.zeros(0, np.int64) for c in names}
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (anchor[starts[1:]] != anchor[starts[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    low = starts[first]
    lead = anchor[low] - low
    context = textkit.mix(textkit.span_hash(prefix, low, low + n - 1 + length) + lead.astype(np.uint64) * np.uint64(textkit.BASE))
    return dict(zip(names, (text[low], low - offsets[text[low]], n, lead, hashes[anchor[low]].view(np.int64), context.view(np.int64))))


def segments(column: pa.Array, length: int, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, base, bytes, offsets): runs of texts, or parts of a long text that overlap by length - 1 bytes; base is where each begins in its text."""
    whole, ends = textkit.utf8(column)
    for first, past, buf, offsets in textkit.chunks(whole, ends, segment):
        if len(buf) <= segment:
            yield np.arange(first, past), np.zeros(past - first, np.int64), buf, offsets
            continue
        for at in range(0, len(buf) - length + 1, segment):
            part = buf[at : at + segment + length - 1]
            yield np.array([first]), np.array([at]), part, np.array([0, len(part)])


RUNS = "node long, at int, n int, lead int, bucket long, context long"


def find_runs(texts: DataFrame, length: int, gram: int, segment: int = SEGMENT) -> DataFrame:
    """node, text to the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, base, buf, offsets in segments(batch.column(1), length, segment):
                r = anchors(buf, offsets, length, gram)
                columns = [node[rows][r["text"]], (r["at"] + base[r["text"]]).astype(np.int32), r["n"].astype(np.int32), r["lead"].astype(np.int32), r["bucket"], r["context"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "at", "n", "lead", "bucket", "context"])

    return texts.select("node", "text").mapInArrow(run, RUNS)


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A list<struct<ints>> column as row numbers and flat fields."""
    column = batch.column(batch.schema.get_field_index(name))
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return rows, {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}


def texts_with_lists(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """(node, bytes, fields) of each row with columns node, text and a list."""
    for batch in batches:
        node = batch.column(batch.schema.get_field_index("node")).to_pylist()
        buf, offsets = textkit.utf8(batch.column(batch.schema.get_field_index("text")))
        rows, fields = lists(batch, name)
        cut = np.searchsorted(rows, np.arange(len(node) + 1))
        for i, x in enumerate(node):
            yield x, buf[offsets[i] : offsets[i + 1]], {k: v[cut[i] : cut[i + 1]] for k, v in fields.items()}


def batched(rows: Iterator[tuple], names: list[str], limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of arrays, of about limit values each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def window_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of one text, from prefix sums over stretches of it."""
    out = np.zeros(len(starts), np.uint64)
    part = starts // SEGMENT
    for p in np.unique(part):
        which = np.flatnonzero(part == p)
        low, high = int(starts[which].min()), int(ends[which].max())
        prefix = textkit.prefix_hash(buf[low:high])
        out[which] = textkit.span_hash(prefix, starts[which] - low, ends[which] - low)
    return out


def block_ranks(marked: DataFrame, length: int, block: int) -> DataFrame:
    """node, text, runs (at, n, lead, subject) to blocks: node, at, n, subject, rank, core."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for node, buf, run in texts_with_lists(batches, "runs"):
            if not len(run["at"]):
                continue
            anchor, last = run["at"] + run["lead"], run["at"] + run["n"] - 1
            # Block b has the starts anchor - block*(b+1) + 1 .. anchor - block*b.
            low_b, high_b = (anchor - last) // block, (anchor - run["at"]) // block
            count = high_b - low_b + 1
            of = np.repeat(np.arange(len(count)), count)
            b = np.repeat(low_b, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            top, bottom = anchor[of] - block * b, anchor[of] - block * (b + 1) + 1
            first, final = np.maximum(bottom, run["at"][of]), np.minimum(top, last[of])
            place = (anchor[of] - first).astype(np.uint64) * np.uint64(textkit.BASE)
            rank = textkit.mix(window_hashes(buf, first, final + length) + place)
            core = textkit.mix(window_hashes(buf, top, bottom + length) + b.astype(np.uint64) * np.uint64(textkit.INVERSE))
            yield np.full(len(of), node), first.astype(np.int32), (final - first + 1).astype(np.int32), run["subject"][of].astype(np.int32), rank.view(np.int64), core.view(np.int64)

    names = ["node", "at", "n", "subject", "rank", "core"]
    return marked.mapInArrow(lambda batches: batched(blocks(batches), names), "node long, at int, n int, subject int, rank long, core long")


def string_hashes(marked: DataFrame, length: int) -> DataFrame:
    """node, text, blocks (at, n) to a row for each start: node, at, string."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for node, buf, block in texts_with_lists(batches, "blocks"):
            starts = np.unique(np.repeat(block["at"], block["n"]) + np.arange(block["n"].sum()) - np.repeat(np.cumsum(block["n"]) - block["n"], block["n"]))
            yield np.full(len(starts), node), starts.astype(np.int32), window_hashes(buf, starts, starts + length).view(np.int64)

    return marked.mapInArrow(lambda batches: batched(strings(batches), ["node", "at", "string"]), "node long, at int, string long")


def repeated_starts(runs: DataFrame, texts: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """node, spans: ranges (at, n) of starts of repeated strings, by text. texts: node, text of all nodes that may have any."""
    classes = runs.groupBy("bucket", "context").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("owner"))
    classes = materialize(classes, "contexts")
    buckets = classes.groupBy("bucket").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("c") == 1, 1)).alias("single")).filter("total > 1")
    buckets = materialize(buckets, "buckets")
    shared = materialize(with_totals(classes, buckets), "shared")
    discard(classes, buckets)
    edge = (F.col("k") > 1) & (F.col("single") > 0)
    marks = runs.join(shared, ["bucket", "context"]).filter((F.col("c") > 1) | edge)
    subject = F.col("c") == 1
    marks = marks.select("node", "at", "n", "lead", (~subject).alias("full"), (edge & (subject | (F.col("node") == F.col("owner")))).alias("edge"), subject.cast("int").alias("subject"))
    marks = materialize(marks.distinct(), "marks")
    discard(shared)
    found = marks.filter("full").select("node", "at", "n")

    listed = marks.filter("edge").groupBy("node").agg(F.collect_list(F.struct("at", "n", "lead", "subject")).alias("runs"))
    blocks = materialize(block_ranks(texts.join(listed, "node"), length, block), "blocks")
    twice = lambda c: materialize(blocks.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(c), f"twice-{c}")
    core, rank = twice("core"), twice("rank")
    shared_core = blocks.join(core, "core")
    ranked = materialize(shared_core.join(rank.withColumn("whole", F.lit(True)), "rank", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "ranked")
    discard(blocks, core, rank)
    found = found.unionByName(ranked.filter("whole and subject = 1").select("node", "at", "n"))

    unsure = ranked.filter("not whole and subject = 1").select("core").distinct()
    rest = ranked.join(unsure, "core", "left_semi").groupBy("node").agg(F.collect_list(F.struct("at", "n")).alias("blocks"))
    strings = materialize(string_hashes(texts.join(rest, "node"), length), "strings")
    again = materialize(strings.groupBy("string").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("string"), "again")
    found = found.unionByName(strings.join(again, "string").select("node", "at", F.lit(1).alias("n")))
    out = materialize(found.groupBy("node").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    discard(marks, ranked, strings, again)
    return out


#: A bucket with more than this part of all contexts is joined by broadcast; there are at most as many of them.
HOT_PARTS = 2000


def with_totals(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """classes with the totals of their buckets. A passage that many texts share is one bucket; its contexts stay where they are."""
    bound = (buckets.agg(F.sum("k")).first()[0] or 0) / HOT_PARTS
    hot = F.broadcast(buckets.filter(F.col("k") > bound))
    cold = classes.join(hot.select("bucket"), "bucket", "left_anti").join(buckets.filter(F.col("k") <= bound).hint("merge"), "bucket")
    return classes.join(hot, "bucket").unionByName(cold)


def cut_texts(marked: DataFrame, length: int) -> DataFrame:
    """node, text, spans (at, n) to node, n_removed, n_spans, kept (the bytes that stay)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, buf, span in texts_with_lists(batches, "spans"):
            edge = np.zeros(len(buf) + 1, np.int32)
            np.add.at(edge, span["at"], 1)
            np.add.at(edge, span["at"] + span["n"] - 1 + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.int64()), pa.array([int(gone.sum())], pa.int64()), pa.array([n_spans], pa.int64()), pa.array([buf[~gone].tobytes()], pa.binary())],
                names=["node", "n_removed", "n_spans", "kept"],
            )

    return marked.mapInArrow(cut, "node long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): each row's id, node, n_bytes and sha256; and for the nodes that lose bytes n_removed, n_spans and kept.

    Texts are shuffled once, and of them only those with a run that may be repeated
    are kept for the later steps.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole).alias("node"), whole.alias("text"))
    rows = named.select("id", "node", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    runs = materialize(find_runs(named.filter(F.octet_length("text") >= length), length, gram, segment), "runs")
    often = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    nodes = runs.join(often, "bucket", "left_semi").select("node").distinct()
    # One row of each text that copies repeat: a key of text and id tells it, so copies spread.
    key = lambda c: F.xxhash64("node", F.coalesce(F.col(c).cast("string"), F.lit("null")))
    owners = named.groupBy("node").agg(F.min("id").alias("first_id")).join(nodes, "node", "left_semi").select(key("first_id").alias("key"))
    texts = named.select("node", "text", key("id").alias("key")).join(owners, "key", "left_semi").dropDuplicates(["key"])
    texts = materialize(texts.select("node", "text"), "texts")
    spans = repeated_starts(runs, texts, length, block)
    discard(runs)
    return rows, cut_texts(texts.join(spans.hint("merge"), "node"), length)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = remove_repeats(table(spark, sf_dir, "documents"))
    lost = materialize(cuts.select("node", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "cuts")
    out = rows.join(lost, "node", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
