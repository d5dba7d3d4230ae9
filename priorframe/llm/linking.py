"""From band buckets to components: candidates, exact verification, distributed union-find.

Nodes are 64-bit content hashes of distinct texts. No step gathers a bucket or a
component in one task: a bucket is reduced to two or four of its members by min and max
(pre-aggregated before the shuffle), each member is compared to those, and
components come from rounds of star contractions, which are joins and minima.

Members of a bucket that then still lie in different components, and of which neither
stood for the bucket, all meet in it where they are few. In a larger bucket they go on
by prefix filtering, which is exact: of two sets that are similar enough, the first few
elements in a common order have one in common. Rare elements come first, so what all
members of a hot bucket share is no key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorframe.llm import textkit
from priorframe.llm.common import discard, materialize
from priorframe.llm.node_filter import maybe_among


def candidate_pairs(bands: DataFrame, global_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (a > b, shared) of nodes that share a bucket with, and one of which stands for, the bucket; and the members of those buckets.

    bands: node, bucket. A bucket's representatives are the least and greatest node in
    an order of its own (nodes and bucket are hashes, so XOR shuffles), and with
    global_order also those in the order of all buckets. Most buckets have one member;
    their rows are set apart before the others are shuffled.
    """
    node, bucket = F.col("node"), F.col("bucket")
    own = node.bitwiseXOR(bucket)
    least = [F.min(own).alias("x0"), F.max(own).alias("x1"), *([F.min("node").alias("r2"), F.max("node").alias("r3")] if global_order else [])]
    reps = bands.groupBy("bucket").agg(*least, F.count(F.lit(1)).alias("n")).filter("x0 <> x1")
    chosen = [F.col("x0").bitwiseXOR(bucket), F.col("x1").bitwiseXOR(bucket), *([F.col("r2"), F.col("r3")] if global_order else [])]
    reps = materialize(reps.select("bucket", F.array_distinct(F.array(*chosen)).alias("reps"), "n"), "buckets")
    met = bands.filter(maybe_among(reps.select(bucket.alias("node")), "bucket")).join(reps, "bucket")
    members = materialize(met, "members")
    discard(reps)
    pairs = members.select("node", F.explode("reps").alias("rep")).filter("node <> rep")
    pairs = pairs.select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b"))
    return materialize(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "pairs"), members


#: Members of a bucket that all meet in it; those of a larger one meet by their prefixes.
ALL_MEET = 128


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label, many (whether more than ALL_MEET are in it) of nodes that share a bucket with one of another component, where neither stands for the bucket."""
    large = members.filter(F.col("n") > F.size("reps") + 1).filter(~F.array_contains("reps", F.col("node"))).select("bucket", "node").distinct()
    known = materialize(large.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), (F.count(F.lit(1)) > ALL_MEET).alias("many")).filter("low <> high")
    out = materialize(known.join(mixed.select("bucket", "many"), "bucket"), "open")
    discard(known)
    return out


#: Counters of elements; what is broadcast is 4 bytes for each.
SLOTS = 1 << 20
#: Bytes of text whose prefixes are made at once: an element becomes a row of some 200 bytes, in Python and in the JVM.
PREFIX_BYTES = 1 << 18
#: Columns of the parity bits of a set.
PARITY = tuple(f"b{i}" for i in range(8))
#: Pairs of a key that a join row group may try; a key with more is dealt out.
KEY_PAIRS = 1 << 20


#: Odd factors that tell apart the copies of an element, and the texts of a batch.
COPY, TEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def units(hashes: np.ndarray, texts: np.ndarray, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of weight, and its text: the j-th occurrence of an element in a text is element (hash, j).

    Without weighted only first occurrences count.
    """
    of_text = textkit.mix(hashes + texts.astype(np.uint64) * TEXT)
    ordered = np.sort(of_text)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return textkit.mix(hashes), texts
    again = np.flatnonzero(np.isin(of_text, twice))
    again = again[np.argsort(of_text[again], kind="stable")]
    copy = np.zeros(len(hashes), np.uint64)
    copy[again] = nth(of_text[again])
    if not weighted:
        return textkit.mix(hashes[copy == 0]), texts[copy == 0]
    return textkit.mix(hashes + copy * COPY), texts


def nth(ordered: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one of a sorted array."""
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return np.arange(len(ordered)) - np.repeat(begin, np.diff(np.append(begin, len(ordered))))


def slots(elements: np.ndarray) -> np.ndarray:
    return (elements % np.uint64(SLOTS)).astype(np.int64)


def element_counts(texts: DataFrame, shingles: Callable, weighted: bool) -> np.ndarray:
    """How many elements of texts fall into each of SLOTS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(0)), STEP_BYTES):
                total += np.bincount(slots(units(*shingles(buf, offsets), weighted)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 0xFFFFFFFF)
    return out


def parity(element: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A word for each of PARITY and each of n sets: the parity of how many elements fall on each bit.

    Sets differ in at least as many elements as in bits.
    """
    bit = (element >> np.uint64(40)).astype(np.int64) % (64 * len(PARITY))
    words = np.zeros(n * len(PARITY), np.uint64)
    np.bitwise_xor.at(words, owner * len(PARITY) + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return words.view(np.int64).reshape(n, len(PARITY)).T


def prefixes(texts: DataFrame, shingles: Callable, threshold: float, weighted: bool) -> DataFrame:
    """node, label, shared, text to node, label, shared, size, parity bits, and the elements of its prefix: key, pos, idx, and q1, q2 (the two before it).

    The order is by counter, then by hash. Two sets of similarity threshold have
    their first common element in the prefix of the larger one, and where idx holds
    in that of the smaller one.
    """
    counts = texts.sparkSession.sparkContext.broadcast(element_counts(texts, shingles, weighted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, past, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(3)), PREFIX_BYTES):
                element, owner = units(*shingles(buf, offsets), weighted)
                order = np.lexsort((element, counts.value[slots(element)], owner))
                element, owner = element[order], owner[order]
                size = np.bincount(owner, minlength=past - first)
                pos = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
                least = lambda share: (size - np.ceil(size * share - 1e-9).astype(np.int64) + 1)[owner]
                bits = parity(element, owner, past - first)
                # The elements before, or the node where there is none.
                ahead = [np.where(pos < j, node[first:past][owner], np.roll(element, j).view(np.int64)) for j in (1, 2)]
                keep = pos < least(threshold)
                idx = (pos < least(2 * threshold / (1 + threshold)))[keep]
                element, owner, pos = element[keep], owner[keep], pos[keep]
                columns = [node[first:past][owner], label[first:past][owner], size[owner].astype(np.int64), element.view(np.int64), pos, idx, *(q[keep] for q in ahead), *bits[:, owner]]
                shared = batch.column(2).take(pa.array(first + owner))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), shared], names=["node", "label", "size", "key", "pos", "idx", "q1", "q2", *PARITY, "shared"])

    return texts.select("node", "label", "shared", "text").mapInArrow(run, f"node long, label long, size long, key long, pos long, idx boolean, q1 long, q2 long, {', '.join(f'{p} long' for p in PARITY)}, shared array<int>")


def prefix_pairs(texts: DataFrame, shingles: Callable, threshold: float, weighted: bool) -> DataFrame:
    """Pairs (a > b) of nodes of different labels that hold all pairs of similarity threshold that share a bucket. texts: node, label, shared, text.

    Of two labels one is not the most common of the key, so only its other nodes meet all.
    Of the pairs that meet, those go on that share a bucket, and that sizes, positions and parity bits leave similar;
    where the elements just before are common too, the pair has met before.
    """
    rows = materialize(prefixes(texts, shingles, threshold, weighted), "prefixes")
    of = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    keys = of.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top")).filter("n > most")
    keys = materialize(keys.select("key", "top", F.least("n", F.ceil(F.col("n") * (F.col("n") - F.col("most")) / KEY_PAIRS)).cast("int").alias("deal")), "keys")
    met = materialize(rows.join(keys, "key"), "met")
    discard(rows, keys)
    side = lambda df, x: df.select("key", "salt", *(F.col(c).alias(c + x) for c in ("node", "label", "size", "pos", "idx", "q1", "q2", "shared", *PARITY)))
    x = side(met.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("deal")).cast("int")), "_x")
    y = side(met.filter("label <> top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))), "_y")
    smaller = F.struct("size_x", "node_x") < F.struct("size_y", "node_y")
    # What a first common element leaves; a pair that is similar passes at its first.
    common = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    apart = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITY), F.lit(0))
    met = (
        (F.col("label_x") != F.col("label_y")) & F.when(smaller, F.col("idx_x")).otherwise(F.col("idx_y"))
        & (F.least("size_x", "size_y") >= threshold * F.greatest("size_x", "size_y") - 1e-9)
        & (common >= threshold / (1 + threshold) * (F.col("size_x") + F.col("size_y")) - 1e-9)
        & (apart <= (1 - threshold) / (1 + threshold) * (F.col("size_x") + F.col("size_y")) + 1e-9)
        & ~F.col("q1_x").isin(F.col("q1_y"), F.col("q2_y")) & ~F.col("q2_x").isin(F.col("q1_y"), F.col("q2_y"))
        & F.arrays_overlap("shared_x", "shared_y")
    )
    return x.join(y, ["key", "salt"]).filter(met).select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def sketches(texts: DataFrame, shingles: Callable, weighted: bool) -> DataFrame:
    """node, text to node, size and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1)), PREFIX_BYTES):
                element, owner = units(*shingles(buf, offsets), weighted)
                size = np.bincount(owner, minlength=past - first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:past], *(pa.array(c) for c in (size, *parity(element, owner, past - first)))], names=["node", "size", *PARITY])

    return texts.select("node", "text").mapInArrow(run, f"node long, size long, {', '.join(f'{p} long' for p in PARITY)}")


def bucket_pairs(members: DataFrame, texts: DataFrame, shingles: Callable, threshold: float, weighted: bool) -> DataFrame:
    """Pairs (a > b) of members (bucket, node, label) of a bucket that have different labels and that sizes and parity bits leave similar.

    A bucket has at most ALL_MEET members, so each meets no more than that in it.
    """
    drawn = materialize(members.select("bucket", "node", "label").join(sketches(texts, shingles, weighted), "node"), "sketches")
    side = lambda x: drawn.select("bucket", *(F.col(c).alias(c + x) for c in ("node", "label", "size", *PARITY)))
    apart = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITY), F.lit(0))
    met = (
        (F.col("node_x") > F.col("node_y")) & (F.col("label_x") != F.col("label_y"))
        & (F.least("size_x", "size_y") >= threshold * F.greatest("size_x", "size_y") - 1e-9)
        & (apart <= (1 - threshold) / (1 + threshold) * (F.col("size_x") + F.col("size_y")) + 1e-9)
    )
    out = materialize(side("_x").join(side("_y"), "bucket").filter(met).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct(), "met")
    discard(drawn)
    return out


def is_star(pairs: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    roles = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    clash = roles.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 or (ups = 1 and low = 0)")
    return clash.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for nodes of edges (a, b) that are not the least.

    Rounds of large-star and small-star contractions until only stars are left.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    state = materialize(pairs, "components")
    while not is_star(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large, "large")
        discard(state, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        state = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(large, least)
    out = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out.work_path = state.work_path
    return out


#: Bytes of text that a step of the verification works on.
STEP_BYTES = 2 << 20


def verified(pairs: DataFrame, texts: DataFrame, shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], threshold: float, weighted: bool) -> DataFrame:
    """pairs (a, b) whose Jaccard similarity is at least threshold, with it.

    texts: node, text, one row a node. shingles(bytes, offsets): hashes and the text of
    each, for many texts at once; with weighted a hash weighs as often as it occurs.
    Texts grow with the data, so the joins say that they are shuffled at any size.
    """
    t = texts.select("node", "text").hint("merge")
    joined = pairs.select("a", "b").join(t.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "ta", "tb"))
            size = np.cumsum(np.diff(textkit.utf8(ta)[1]) + np.diff(textkit.utf8(tb)[1]))
            first = 0
            while first < len(a):
                past = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + STEP_BYTES, "right")))
                part = slice(first, past)
                value = similarities(a[part], b[part], ta[part], tb[part], shingles, weighted)
                keep = pa.array(np.flatnonzero(value >= threshold - 1e-12))
                yield pa.RecordBatch.from_arrays([a[part].take(keep), b[part].take(keep), pa.array(value).take(keep)], names=["a", "b", "similarity"])
                first = past

    return joined.mapInArrow(run, "a long, b long, similarity double")


def similarities(a: pa.Array, b: pa.Array, ta: pa.Array, tb: pa.Array, shingles: Callable, weighted: bool) -> np.ndarray:
    """Jaccard similarity of each pair; a node's text is worked on once, and all pairs by two sorts.

    A sort key has the number of the text or pair above and the high bits of the element below.
    """
    nodes = np.concatenate([a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)])
    _, where, which = np.unique(nodes, return_index=True, return_inverse=True)
    hashes, owner = shingles(*textkit.utf8(pa.concat_arrays([ta, tb]).take(pa.array(where))))
    bits = np.uint64(len(nodes).bit_length())
    up = np.uint64(64) - bits
    keyed = lambda number, element: (number.astype(np.uint64) << up) | (element >> bits)
    key = np.sort(keyed(owner, hashes))
    copy = nth(key)
    if not weighted:
        key, copy = key[copy == 0], copy[copy == 0]
    element = textkit.mix((key << bits) + copy.astype(np.uint64) * COPY)
    size = np.bincount((key >> up).astype(np.int64), minlength=len(where))
    start = np.cumsum(size) - size
    i, j = which[: len(a)], which[len(a) :]
    pair = np.arange(len(a))
    both = np.sort(np.concatenate([keyed(np.repeat(pair, size[x]), element[textkit.ranges(start[x], size[x])]) for x in (i, j)]))
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> up).astype(np.int64), minlength=len(a))
    union = size[i] + size[j] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def link(bands: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingles: Callable, threshold: float, global_order: bool = True, weighted: bool = True) -> DataFrame:
    """node, label of nodes that are linked to another, but for the least of each component.

    texts_of(nodes): node, text for a frame of nodes. First each node is compared to
    the candidate it shares most buckets with; a second round verifies only the pairs
    that still lie in different components, so a large group costs one text
    comparison a member. A third one takes the members of a bucket that are in
    different components and met none of each other: all similar pairs that share a
    bucket are in one component in the end.
    """
    pairs, members = candidate_pairs(bands, global_order)
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = materialize(texts_of(nodes), "texts")
    discard(nodes)
    check = lambda found: materialize(verified(found, texts, shingles, threshold, weighted), "links")
    best = pairs.select(F.col("a").alias("node"), "b", "shared").groupBy("node").agg(F.max(F.struct("shared", "b")).alias("p"))
    best = materialize(best.select(F.col("node").alias("a"), F.col("p.b").alias("b")), "best")
    first = check(best)
    labels = connected_components(first)
    discard(first)
    la, lb = (labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
    apart = pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    labels = with_links(labels, check(apart.join(best, ["a", "b"], "left_anti")))
    left = open_members(members, labels)
    few, many = left.filter("not many"), left.filter("many")
    text_of = lambda nodes, name: materialize(texts.join(nodes.hint("merge"), "node"), name)
    # Pairs of the first rounds are verified or in one component.
    unmet = lambda found: materialize(found.join(pairs, ["a", "b"], "left_anti"), "unmet")
    if not few.isEmpty():
        rest = text_of(few.select("node").distinct(), "left")
        met = bucket_pairs(few, rest, shingles, threshold, weighted)
        found = unmet(met)
        labels = with_links(labels, check(found))
        discard(rest, met, found)
    if not many.isEmpty():
        # The high halves of the buckets go with a node.
        rest = text_of(many.groupBy("node", "label").agg(F.collect_set(F.shiftright("bucket", 32).cast("int")).alias("shared")), "left")
        found = unmet(prefix_pairs(rest, shingles, threshold, weighted))
        labels = with_links(labels, check(found))
        discard(rest, found)
    discard(pairs, members, texts, best, left)
    return labels


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of labels and links together; both are used up."""
    if not links.isEmpty():
        old, labels = labels, connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links.select("a", "b")))
        discard(old)
    discard(links)
    return labels
