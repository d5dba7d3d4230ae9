"""Benchmark decontamination by winnowing.

Of each ``WINDOW - GRAM + 1`` consecutive word k-grams the least hash is kept as a
fingerprint, in benchmark items and in documents alike, so any shared span of
WINDOW words shares a fingerprint. A document's fingerprints that occur in the
benchmark are extended: every window of WINDOW words around the hit is looked up and
its words compared. An item with fewer words is one window, looked up whole.

Documents are read once, in place: nothing of them is shuffled. The benchmark is
broadcast in blocks of a checked size, each as sorted arrays of hashes over one buffer of
its words (about 30 bytes a word position beside the words); with more than one block, the
spans found so far are written between blocks, so memory stays that of one block.

Edge cases: a null text or one without words has no hits; a very long text is read whole,
as a chunk of its own; items without words, and
items with a null id, are never reported (the latter's windows still hit); repeated
items are one; repeated rows are judged alike and all stay; extra columns pass
through, but for those with the name of a result column; an empty table gives no
rows and an empty benchmark no hits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorframe.llm import textkit
from priorframe.llm.common import materialize, table

WINDOW = 10
GRAM = 5
#: A block of the benchmark that is broadcast holds at most about this many bytes of text.
BLOCK_BYTES = 16 << 20

RESULT = (
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least gram of each width consecutive ones, each position once."""
    least = textkit.sliding_min(grams, width)
    picked = np.zeros(len(grams), bool)
    # A gram is kept if it equals the minimum of a window that holds it.
    for shift in range(width):
        picked[shift : shift + len(least)] |= grams[shift : shift + len(least)] == least
    return np.flatnonzero(picked)


def item_words(text: str) -> list[bytes]:
    buf = textkit.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = textkit.word_spans(buf, np.array([0, len(buf)]), textkit.WORD)
    return [buf[s:e].tobytes() for s, e in zip(starts, ends)]


@dataclass
class Windows:
    """Distinct windows of one size, by hash: where their bytes stand in the block's buffer, and their owners as a range of the owner list."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray


class Index:
    """Fingerprints and windows of a block of benchmark items, as sorted arrays over one buffer of their words.

    A window of a block costs about 30 bytes beside its words, which stand once in the
    buffer, one blank apart.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.names = window, gram, []
        parts, at = [], 0
        prints: list[np.ndarray] = []
        found: dict[int, list[tuple]] = defaultdict(list)
        for item, text in items:
            words = item_words(text)
            if not words:
                continue
            n = min(window, len(words))
            sizes = np.array([len(w) for w in words])
            ends = at + np.cumsum(sizes + 1) - 1
            values = self.word_hashes(words)
            count = len(words) - n + 1
            found[n].append((textkit.gram_hash(values, n), (ends - sizes)[:count], ends[n - 1 :], np.full(count, len(self.names) if item is not None else -1)))
            if item is not None:
                self.names.append(item)
            if n == window:
                grams = textkit.gram_hash(values, gram)
                prints.append(grams[winnow(grams, window - gram + 1)])
            parts += [*words]
            at = int(ends[-1]) + 1
        self.buffer = b" ".join(parts)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {n: self.distinct(*(np.concatenate(x) for x in zip(*rows))) for n, rows in found.items()}
        self.hashes = {n: np.unique(w.hashes) for n, w in self.windows.items()}

    def distinct(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Windows:
        order = np.lexsort((owner, hashes))
        hashes, starts, ends, owner = hashes[order], starts[order], ends[order], owner[order]
        name = np.arange(len(hashes))  # the first occurrence of each window's bytes
        same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        first: dict[bytes, int] = {}
        for i in same.tolist():
            if i - 1 == 0 or hashes[i - 2] != hashes[i - 1]:  # a new run of equal hashes
                first = {self.buffer[starts[i - 1] : ends[i - 1]]: i - 1}
            name[i] = first.setdefault(self.buffer[starts[i] : ends[i]], i)
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        keep = (owner >= 0) & np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])[: len(name)]
        heads = np.unique(name)
        return Windows(hashes[heads], starts[heads], ends[heads], np.concatenate([np.searchsorted(name[keep], heads), [int(keep.sum())]]), owner[keep])

    def owners_of(self, n: int, value: np.uint64, text: bytes) -> set[str] | None:
        """Items that hold the window of these bytes (value is its hash), or None if no window of the block is equal to it."""
        w = self.windows[n]
        for i in range(int(np.searchsorted(w.hashes, value, "left")), int(np.searchsorted(w.hashes, value, "right"))):
            if self.buffer[w.starts[i] : w.ends[i]] == text:
                return {self.names[k] for k in w.owners[w.owner_at[i] : w.owner_at[i + 1]].tolist()}
        return None

    @staticmethod
    def word_hashes(words: list[bytes]) -> np.ndarray:
        buf = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return textkit.span_hash(textkit.prefix_hash(buf), ends - [len(w) for w in words], ends)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known; a bit table answers for most."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    bits = max(10, min(22, int(math.log2(len(known))) + 6))
    table_ = np.zeros(1 << bits, bool)
    low = np.uint64((1 << bits) - 1)
    table_[known & low] = True
    maybe = np.flatnonzero(table_[values & low])
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    out = np.zeros(len(values), bool)
    out[maybe[known[at] == values[maybe]]] = True
    return out


def candidates(index: Index, hashes: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By window size, starts and hashes of windows that fingerprints or short items point to. first: each text's first word."""
    out = {}
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n, known in index.hashes.items():
        if len(hashes) < n:
            continue
        if n < index.window:
            starts = np.arange(len(hashes) - n + 1)
        else:
            width = index.window - index.gram + 1
            grams = textkit.gram_hash(hashes, index.gram)
            picked = winnow_texts(grams, first, index.gram, width)
            hits = picked[among(grams[picked], index.prints)]
            starts = np.unique((hits[:, None] - np.arange(width)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + n <= len(hashes))]
        starts = starts[text_of[starts] == text_of[starts + n - 1]]
        if n < index.window:
            values = textkit.gram_hash(hashes, n)[starts]
        else:
            rows = hashes[starts[:, None] + np.arange(n)[None, :]]
            values = rows[:, 0].copy()
            for j in range(1, n):
                values = values * np.uint64(textkit.BASE) + rows[:, j]
            values = textkit.mix(values)
        hit = among(values, known)
        out[n] = starts[hit], values[hit]
    return out


def winnow_texts(grams: np.ndarray, first: np.ndarray, k: int, width: int) -> np.ndarray:
    """winnow() over grams of consecutive texts: windows of width grams that lie within one text."""
    least = textkit.sliding_min(grams, width)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    span = width + k - 1
    whole = text_of[: len(least)] == text_of[span - 1 : span - 1 + len(least)]
    picked = np.zeros(len(grams), bool)
    for shift in range(width):
        picked[shift : shift + len(least)] |= whole & (grams[shift : shift + len(least)] == least)
    return np.flatnonzero(picked)


def find_hits(index: Index, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: number of words, spans of hit words, items that occur."""
    counts: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    found: list[set[str]] = []
    for _, _, raw, offsets in textkit.chunks(*textkit.utf8(column)):
        buf = textkit.LOWER[raw]
        starts, ends, first = textkit.word_spans(buf, offsets, textkit.WORD)
        hashes = textkit.span_hash(textkit.prefix_hash(buf), starts, ends)
        counts += np.diff(first).tolist()
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for n, (at, values) in candidates(index, hashes, first).items():
            for s, value in zip(at.tolist(), values):
                owners = index.owners_of(n, value, b" ".join(buf[a:b].tobytes() for a, b in zip(starts[s : s + n], ends[s : s + n])))
                if owners is not None:
                    d = int(np.searchsorted(first, s, "right")) - 1
                    windows[d].append((s - int(first[d]), s - int(first[d]) + n))
                    items[d] |= owners
        for d in range(len(offsets) - 1):
            spans.append(union(windows[d]) if d in windows else [])
            found.append(items.get(d, set()))
    return counts, spans, found


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


#: Parts that a block is made of.
BLOCK_PARTS = 8


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark, repeats left out, in blocks of at most block_bytes of text; a larger one is a single part of its own.

    Rows are dealt to parts by hash, the parts are measured, and blocks are filled with
    whole parts.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes) * BLOCK_PARTS)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    sizes = dealt.groupBy("part").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("part").collect()
    blocks, room = [[]], block_bytes
    for part, size in sizes:
        if size > room and blocks[-1]:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(part)
        room -= size
    for parts in blocks:
        yield [(r["item"], r["text"]) for r in dealt.filter(F.col("part").isin(parts)).collect()]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (in words, merged) and items (sorted)."""
    names = [f.name for f in RESULT]
    state = docs.drop(*(c for c in names if c in docs.columns and c != text))
    plain = state.schema
    for b, items in enumerate(benchmark_blocks(benchmark, item, item_text, block_bytes)):
        if b:
            state = materialize(state, "contamination")
        index = docs.sparkSession.sparkContext.broadcast(Index(items, window, gram))
        schema = T.StructType([*plain.fields, *RESULT])
        arrow = pa.schema([pa.field("n_words", pa.int64()), pa.field("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.field("items", pa.list_(pa.string()))])

        def run(batches: Iterator[pa.RecordBatch], index=index, later=bool(b)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, found = find_hits(index.value, batch.column(batch.schema.get_field_index(text)))
                if later:
                    old = [[(x["start"], x["end"]) for x in row] for row in batch.column(batch.num_columns - 2).to_pylist()]
                    spans = [union(x + y) for x, y in zip(spans, old)]
                    found = [x | set(y) for x, y in zip(found, batch.column(batch.num_columns - 1).to_pylist())]
                keep = range(batch.num_columns - 3 * later)
                columns = [batch.column(i) for i in keep]
                columns += [
                    pa.array(counts, arrow[0].type),
                    pa.array([[{"start": s, "end": e} for s, e in row] for row in spans], arrow[1].type),
                    pa.array([sorted(x) for x in found], arrow[2].type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in keep), *names])

        state = state.mapInArrow(run, schema)
    return state


def contaminated() -> F.Column:
    return F.size("hit_spans") > 0


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
       FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
             FROM (SELECT item, ws, CAST(least(10, len(ws)) AS BIGINT) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT rid, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS o FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
SQL = {"op6_benchmark_decontamination": OP6_SQL}
