"""Quality: Bradley-Terry ranking of documents from preference pairs.

A document's strength is linear in its features. Of a labelled good and a labelled bad
document the good one is preferred, with the probability sigmoid(strength difference),
so the weights are fitted by logistic loss on differences of features; there is no
intercept. The score that parts good from bad is then a quantile of strengths: that of
the share of bad documents among all labelled ones. It is read off strengths given by
models that have not seen the document, and scores are moved so that it stands at
``CUT`` (0.7).

Features are measures of a text's shape (lengths, symbols, capitals, digits, repeats,
lines) and square roots of the shares of ``BUCKETS`` hashed words. They are taken by
tasks, from whole texts. All labelled documents that are not held out are learned from:
they are dealt by the hash of the id into shares of about ``SHARE``, each share's pairs are
fitted in one task, and as strengths are linear, the mean of the shares' weights is the
mean of their strengths. Shares are of two halves; the documents of one half have their
unseen strength from the mean of the other, and the cut is the quantile of them all. What
comes to the driver are means. At most two shares are fitted as one set.

Edge cases: null and empty texts have the features of a text without words (all zero);
texts of any length are read whole, one at a time beyond the chunk size; a null label or
id is no label; of several labels of one id the least counts, of several texts that of
the least hash; with labels of one class alone all scores are the share of good ones, and
with none CUT; repeated rows are scored alike and all stay; extra columns pass through
whatever their names, and columns named as a result are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorframe.llm import textkit
from priorframe.llm.common import boxed, discard, materialize, table
from priorframe.operators.ranking import exact_quantiles

SHARE = 2048
#: So many good and bad documents a share has, by copies in several shares of a half if one kind is rare.
LEAST = 16
#: Labels that are broadcast to the texts; more are joined by a shuffle.
MOST_SENT = 1_000_000
BUCKETS = 1024
CUT = 0.7
EPOCHS = 12
BATCH = 64
RATE = 0.03
DECAY = 1e-4
CHUNK = 1 << 20

UPPER = textkit.byte_class((0x41, 0x5A))
LETTER = textkit.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
DIGIT = textkit.byte_class((0x30, 0x39))
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
MARK = textkit.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Shares come twice, plain and as square roots, which tell none from little.
SHARES = ("no_letter", "symbol", "shout", "stop", "upper", "digit", "mark", "same_as_last", "repeated_pairs", "repeated_lines")
SHAPES = ("log_words", "word_bytes", "line_words") + SHARES + tuple(f"root_{s}" for s in SHARES)
WIDTH = len(SHAPES) + BUCKETS


def repeats(text_of: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many keys of each text equal an earlier key of it."""
    order = np.lexsort((keys, text_of))
    t, k = text_of[order], keys[order]
    again = np.zeros(len(t), bool)
    again[1:] = (t[1:] == t[:-1]) & (k[1:] == k[:-1])
    return np.bincount(t[again], minlength=n).astype(float)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature vectors (texts x WIDTH) of whole texts."""
    n = len(offsets) - 1
    starts, ends, first = textkit.word_spans(buf, offsets, textkit.NOT_BLANK)
    words = np.diff(first)
    word_text = np.repeat(np.arange(n), words)
    byte_text = np.repeat(np.arange(n), np.diff(offsets))
    at_least_one = np.maximum(words, 1)

    def of_bytes(member: np.ndarray) -> np.ndarray:
        return np.bincount(byte_text[member[buf]], minlength=n).astype(float)

    def of_words(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(word_text[chosen], minlength=n) / at_least_one

    def inside(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member[buf])])
        return total[ends] > total[starts]

    low = textkit.LOWER[buf]
    name = textkit.span_hash(textkit.prefix_hash(low), starts, ends)
    after = word_text[1:] == word_text[:-1]
    pairs = textkit.gram_hash(name, 2)[after] if len(name) > 1 else name[:0]
    # Lines with a word: a line's key is the hash of its words' sum of positions' hashes within it.
    line = np.cumsum(buf == 0x0A)[starts] if len(starts) else np.zeros(0, np.int64)
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (line[1:] != line[:-1]) | ~after
    heads = np.flatnonzero(new_line)
    prefix = textkit.prefix_hash(buf)
    tails = np.concatenate([heads[1:], [len(starts)]])[: len(heads)] - 1
    line_text = word_text[heads]
    lines = np.bincount(line_text, minlength=n)
    line_key = textkit.span_hash(prefix, starts[heads], ends[tails])
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(name), bool)
    same[1:] = after & (name[1:] == name[:-1])
    n_bytes = np.maximum(np.bincount(word_text, weights=ends - starts, minlength=n), 1)
    share = {
        "no_letter": of_words(~inside(LETTER)), "symbol": of_words(inside(SYMBOL)), "shout": of_words(last == ord("!")), "stop": of_words(STOP[last]),
        "upper": of_bytes(UPPER) / np.maximum(of_bytes(LETTER), 1), "digit": of_bytes(DIGIT) / n_bytes, "mark": of_bytes(MARK) / n_bytes, "same_as_last": of_words(same),
        "repeated_pairs": repeats(word_text[1:][after], pairs, n) / np.maximum(words - 1, 1), "repeated_lines": repeats(line_text, line_key, n) / np.maximum(lines, 1),
    }
    plain = [np.log1p(words), np.log1p(np.where(words > 0, n_bytes, 0) / at_least_one), np.log1p(words / np.maximum(lines, 1))]
    shape = np.stack([*plain, *(share[s] for s in SHARES), *(np.sqrt(share[s]) for s in SHARES)], axis=1)
    bucket = (name & np.uint64(BUCKETS - 1)).astype(np.int64)
    bag = np.bincount(word_text * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / at_least_one[:, None]
    return np.concatenate([shape, np.sqrt(bag)], axis=1)


@dataclass
class Ranking:
    """Weights of features after they are moved and scaled; cut is the strength that scores CUT."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) * self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.strength(x) - self.cut + math.log(CUT / (1 - CUT)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pair_loss(weights: np.ndarray, difference: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferences (rows: preferred minus other) with its decay, and the gradient."""
    margin = difference @ weights
    loss = np.logaddexp(0, -margin).mean() + DECAY / 2 * weights @ weights
    return float(loss), -(difference * sigmoid(-margin)[:, None]).mean(axis=0) + DECAY * weights


def rank_pairs(x: np.ndarray, good: np.ndarray, seed: int) -> Ranking:
    """Weights fitted to pairs of a good and a bad document: each document in at least one pair of every epoch."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    scale[len(SHAPES) :] = 4.0  # shares of words keep their own weight: rare buckets have no spread to speak of
    z = (x - centre) * scale
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    n = max(len(better), len(worse))
    deal = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    for _ in range(EPOCHS):
        a, b = deal(better), deal(worse)
        for i in range(0, n, BATCH):
            _, slope = pair_loss(w, z[a[i : i + BATCH]] - z[b[i : i + BATCH]])
            t += 1
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ranking(centre, scale, w)


def quantile_cut(strength: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Strength below which the given share of the weight lies: half way between its two neighbours."""
    order = np.argsort(strength, kind="stable")
    s, w = strength[order], np.cumsum(weight[order])
    i = int(np.searchsorted(w, share * w[-1] * (1 - 1e-12), "left"))
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def fit(x: np.ndarray, good: np.ndarray, bad_share: float | None, seed: int = 0) -> Ranking:
    """A ranking of a sample; bad_share is that among all labelled rows (None: there are none)."""
    if bad_share is None or not len(good) or good.all() or not good.any():
        none = np.zeros(WIDTH)
        return Ranking(none, none, none, constant=CUT if bad_share is None else 1 - bad_share)
    model = rank_pairs(x, good, seed)
    unseen = model.strength(x)
    half = np.zeros(len(good), int)
    rng = np.random.default_rng(seed)
    for kind in (True, False):  # as many of each kind in both halves
        half[rng.permutation(np.flatnonzero(good == kind))[::2]] = 1
    for k in (0, 1):
        rest = half != k
        if rest.any() and good[rest].any() and not good[rest].all():
            unseen[half == k] = rank_pairs(x[rest], good[rest], seed).strength(x[half == k])
    weight = np.where(good, (1 - bad_share) / good.mean(), bad_share / (1 - good.mean()))
    model.cut = quantile_cut(unseen, weight, bad_share)
    return model


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2


def _features(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, WIDTH)), *(features(buf, offsets) for _, _, buf, offsets in textkit.chunks(*textkit.utf8(texts), CHUNK))])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), batch.column("good")], names=["id", "x", "good"])


def dealt(rows: DataFrame, totals: dict[bool, int], shares: int, seed: int) -> DataFrame:
    """rows (id, text, good) with their half and their share, an even number of shares in all; a kind of fewer than LEAST a share is in several of its half."""
    key = F.xxhash64(F.lit(seed), "id")
    half, place = F.pmod(key, F.lit(2)).cast("int"), F.pmod(F.shiftright(key, 1), F.lit(shares // 2))
    copies = {kind: min(shares // 2, -(-LEAST * shares // max(totals.get(kind, 0), 1))) for kind in (True, False)}
    nth = F.explode(F.sequence(F.lit(0), F.when(F.col("good"), copies[True]).otherwise(copies[False]) - 1))
    spread = rows.select("*", half.alias("half"), place.alias("place"), nth.alias("nth"))
    return spread.select("id", "text", "good", "half", (2 * F.pmod(F.col("place") + F.col("nth"), F.lit(shares // 2)) + F.col("half")).cast("int").alias("share"))


def fit_shares(rows: DataFrame, totals: dict[bool, int], shares: int, seed: int = 0) -> Ranking:
    """A ranking of all rows (id, text, good): the mean of those of the shares, cut by strengths from the shares of the other half."""

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        x, good = _features(part.column("text")), np.asarray(part.column("good").to_pylist(), bool)
        if good.all() or not good.any():
            return pa.table({"half": pa.array([], pa.int32()), "place": pa.array([], pa.int32()), "weight": pa.array([], pa.float64()), "centre": pa.array([], pa.float64())})
        model = rank_pairs(x, good, seed)
        half = np.full(WIDTH, part.column("half")[0].as_py(), np.int32)
        return pa.table({"half": half, "place": np.arange(WIDTH, dtype=np.int32), "weight": model.weights * model.scale, "centre": model.centre})

    fitted = dealt(rows, totals, shares, seed).groupBy("share").applyInArrow(one, "half int, place int, weight double, centre double")
    sums = fitted.groupBy("half", "place").agg(F.sum("weight").alias("weight"), F.sum("centre").alias("centre"), F.count(F.lit(1)).alias("n")).collect()
    weight, centre, n = np.zeros((2, WIDTH)), np.zeros(WIDTH), np.zeros(2)
    for r in sums:
        weight[r["half"], r["place"]], n[r["half"]] = r["weight"], r["n"]
        centre[r["place"]] += r["centre"]
    centre /= n.sum()
    model = Ranking(centre, np.ones(WIDTH), weight.sum(axis=0) / n.sum())
    # By half, the mean of the other one (of both, if it has none).
    others = [Ranking(centre, model.scale, weight[1 - h] / n[1 - h] if n[1 - h] else model.weights) for h in (0, 1)]
    shared = rows.sparkSession.sparkContext.broadcast(others)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = _features(batch.column("text")), np.asarray(batch.column("half"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.where(half == 0, shared.value[0].strength(x), shared.value[1].strength(x)))], names=["id", "strength"])

    halves = rows.select("id", "text", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)).cast("int").alias("half"))
    strengths = materialize(halves.mapInArrow(unseen, "id string, strength double"), "strengths")
    found = strengths.count()
    at = math.ceil(totals[False] / sum(totals.values()) * found * (1 - 1e-12)) - 1
    model.cut = exact_quantiles(strengths, "strength", ["id"], [min(at + 0.5, found - 1) / (found - 1)])[0]
    discard(strengths)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", share_rows: int = SHARE, seed: int = 0) -> Ranking:
    """A ranking by all labels that are not held out; at most two shares are fitted as one set, of which the vectors come to the driver."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    usable = usable.groupBy(F.col(id_col).cast("string").alias("id")).agg((F.min(label) > 0).alias("good"))
    totals = {r["good"]: r["n"] for r in usable.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(totals.values())
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(usable) if n <= MOST_SENT else usable, "id")
    rows = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("good").alias("good"))
    if n > 2 * share_rows and len(totals) == 2:
        rows = materialize(rows, "labelled")
        found = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
        if sum(found.values()) > 2 * share_rows and len(found) == 2:
            model = fit_shares(rows, totals, 2 * -(-sum(found.values()) // (2 * share_rows)), seed)
            discard(rows)
            return model
    vectors = rows.mapInArrow(_feature_batches, "id string, x array<float>, good boolean").orderBy("id").toArrow()
    x = np.asarray(vectors.column("x").combine_chunks().flatten(), float).reshape(-1, WIDTH)
    return fit(x, np.asarray(vectors.column("good").to_pylist(), bool), totals.get(False, 0) / n if n else None, seed)


def score_documents(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """docs with score, strength and predicted (1 where the score is CUT or more)."""
    names = ["score", "strength", "predicted"]
    plain = boxed(docs, F.col(f"`{text}`").alias("text"), names=[c for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([plain.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("strength", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [(m.score(x), m.strength(x)) for x in (features(buf, offsets) for _, _, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1)), CHUNK))]
            score, strength = (np.concatenate([np.zeros(0), *(p[i] for p in parts)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(strength), pa.array((score >= CUT).astype(np.int32))], names=["row", *names])

    return plain.mapInArrow(run, schema).select("row.*", *names)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "strength")


QUERIES = {"op13_quality_classifier": op13_quality_classifier}
SQL: dict[str, str] = {}
