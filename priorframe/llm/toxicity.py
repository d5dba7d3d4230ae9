"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to buckets, and the buckets seen in two or more training documents
have an embedding; all others share a zero vector. Filters of widths 1, 2 and 3 run
over the embeddings, each filter's maximum over the whole text goes through a
rectifier, and a logistic unit joins them. The first coordinate of an embedding
starts as the word's association with the label (a signed square root of the
likelihood ratio), the others are random; all are trained by gradient descent.

All labelled rows that are not held out are learned from. Up to ``ONE_SET`` of them are
fitted as one set on the driver. More are dealt by the hash of the id into shares of about
``SHARE`` rows: words are counted by label over all rows, and in each of ``ROUNDS`` rounds
every share trains a copy of the model in one task, of which the means (of a word's vector,
over the shares that changed it) are the next model. Shares are of two halves, each with a
model of its own beside that of all; the scores that thresholds are set from are those of
the other half's model, counted in steps of a thousandth of log odds. What comes to the
driver are models and counts. Scoring reads every text, whole, once and in place. Texts alone are input of a score; the language only picks
which threshold the column ``flagged`` uses.

Edge cases: null and empty texts have the score of a text of unknown words; a null
label is no label; of several labels of one id the highest counts; with no labelled
row of either class all scores are the share of positives; a null language has the
threshold of all; a very long text is scored whole, as a chunk of its own; repeated rows
are scored alike and all stay; extra columns pass through, whatever their names, unless
they have the name of a result column; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorframe.llm import textkit
from priorframe.llm.common import boxed, discard, materialize, table

ONE_SET = 4500
SHARE = 2048
ROUNDS = 3
#: Labels that are broadcast to the texts; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Epochs of a share in a round.
SHARE_EPOCHS = 2
BUCKET_BITS = 22
WIDTHS = (1, 2, 3)
DIMENSIONS = 8
FILTERS = 6
#: Epochs of one set.
EPOCHS = 6
BATCH = 32
CHUNK = 1 << 20


def word_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (lower case) of all texts and each text's first word (n + 1); texts have WIDTHS[-1] words at least, of bucket -1 where they run out."""
    low = textkit.LOWER[buf]
    starts, ends, first = textkit.word_spans(low, offsets, textkit.WORD)
    buckets = (textkit.span_hash(textkit.prefix_hash(low), starts, ends) & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
    n = np.diff(first)
    short = np.maximum(WIDTHS[-1] - n, 0)
    if short.any():
        buckets = np.insert(buckets, np.repeat(first[1:], short), -1)
        first = np.concatenate([[0], np.cumsum(n + short)])
    return buckets, first


@dataclass
class Model:
    """Embedding rows (0 is the unknown word) by bucket, filters by width, the logistic unit, thresholds by language."""

    buckets: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width: (width, dimensions, filters)
    shifts: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_row"):
            self._row = np.zeros((1 << BUCKET_BITS) + 1, np.int32)
            self._row[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return self._row[buckets]

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of all filters (texts x filters), before the rectifier, and the positions they come from."""
        tops, places = [], []
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        used, at = np.unique(rows, return_inverse=True)
        vectors = self.vectors[used]
        for w in WIDTHS:
            n = len(rows) - w + 1
            s = sum((vectors @ self.filters[w][j]).astype(np.float32)[at[j : j + n]] for j in range(w))
            if w > 1:
                s[text_of[:n] != text_of[w - 1 : w - 1 + n]] = -np.inf
            # One maximum finds value and place: ordered float bits above, the place (first wins) below.
            bits = s.view(np.int32)
            key = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32
            key |= (0xFFFFFFFF - np.arange(n, dtype=np.int64))[:, None]
            place = 0xFFFFFFFF - (np.maximum.reduceat(key, first[:-1], axis=0) & 0xFFFFFFFF)
            tops.append(np.take_along_axis(s, place, axis=0) + self.shifts[w])
            places.append(place)
        return np.concatenate(tops, axis=1), np.concatenate(places, axis=1)

    def top(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The maxima alone."""
        if not hasattr(self, "_ready"):
            self._ready = {w: [(self.vectors @ self.filters[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        out = []
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for w, parts in self._ready.items():
            n = len(rows) - w + 1
            s = parts[0][rows[:n]]
            for j in range(1, w):
                s += parts[j][rows[j : j + n]]
            if w > 1:
                s[text_of[:n] != text_of[w - 1 : w - 1 + n]] = -np.inf
            out.append(np.maximum.reduceat(s, first[:-1], axis=0) + self.shifts[w])
        return np.concatenate(out, axis=1)

    def score(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        if not len(self.weights):
            return np.full(len(first) - 1, sigmoid(self.intercept))
        return sigmoid(np.maximum(self.top(self.rows(buckets), first), 0) @ self.weights + self.intercept)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def associations(buckets: np.ndarray, text_of: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in two or more texts, and the signed root of each one's likelihood ratio with the label."""
    pair = np.unique(np.stack([buckets, text_of]), axis=1)
    pair = pair[:, pair[0] >= 0]
    known, inverse = np.unique(pair[0], return_inverse=True)
    n1 = np.bincount(inverse, weights=labels[pair[1]], minlength=len(known))
    n = np.bincount(inverse, minlength=len(known)).astype(float)
    keep = n >= 2
    return known[keep], gains(n, n1, len(labels), labels.sum())[keep]


def gains(n: np.ndarray, n1: np.ndarray, total: float, positive: float) -> np.ndarray:
    """Signed root of the likelihood ratio with the label, of words in n texts, n1 of them positive."""
    share = positive / total
    gain = np.zeros(len(n))
    for seen, expected in ((n1, n * share), (n - n1, n * (1 - share)), (positive - n1, (total - n) * share), (total - positive - n + n1, (total - n) * (1 - share))):
        gain += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.sign(n1 - n * share) * np.sqrt(np.maximum(2 * gain, 0))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, name, value: np.ndarray, slope: np.ndarray) -> None:
        m, v, t = self.state.get(name, (np.zeros_like(value), np.zeros_like(value), 0))
        m, v, t = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2, t + 1
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.state[name] = (m, v, t)


def fit(texts: list[str], labels: np.ndarray, share: float, languages: list[str | None], seed: int = 0) -> Model:
    """Train on a sample; share is that of positives among all labelled rows.

    Thresholds come from scores of models that have not seen the row: each half of
    the sample is scored by a model of the other half.
    """
    prior = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    labels = labels.astype(float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(0, np.int64), np.zeros((1, DIMENSIONS)), intercept=prior)
    parts = [word_buckets(buf, offsets) for _, _, buf, offsets in textkit.chunks(*textkit.utf8(pa.array(texts, pa.large_string())), CHUNK)]
    buckets = np.concatenate([b for b, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])

    def part(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([buckets[first[d] : first[d + 1]] for d in pick]), np.concatenate([[0], np.cumsum(np.diff(first)[pick])])

    model = train_network(buckets, first, labels, seed)
    model.intercept += prior
    rng = np.random.default_rng(seed)
    half = np.zeros(len(labels), int)
    for y in (0.0, 1.0):  # as many of each label in both halves
        rows = rng.permutation(np.flatnonzero(labels == y))
        half[rows[::2]] = 1
    unseen = np.full(len(labels), sigmoid(prior))
    for k in (0, 1):
        fold, rest = np.flatnonzero(half == k), np.flatnonzero(half != k)
        if 0 < labels[rest].sum() < len(rest):
            other = train_network(*part(rest), labels[rest], seed)
            other.intercept += prior
            unseen[fold] = other.score(*part(fold))
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    # Scores are moved so that one half is the threshold of the best F1 over all languages.
    move = logit(calibrate(unseen, labels, weight, languages)[""])
    model.intercept -= move
    model.thresholds = calibrate(sigmoid(logit(unseen) - move), labels, weight, languages)
    return model


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def train_network(buckets: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int) -> Model:
    """Embeddings, filters and unit; the intercept is that of a sample with as many of both labels."""
    rng = np.random.default_rng(seed)
    known, gain = associations(buckets, np.repeat(np.arange(len(labels)), np.diff(first)), labels)
    model = started(known, gain, rng)
    odds = math.log(labels.mean() / (1 - labels.mean()))
    model.intercept = odds
    descend(model, buckets, first, labels, EPOCHS, rng)
    model.intercept -= odds
    return model


def started(known: np.ndarray, gain: np.ndarray, rng: np.random.Generator) -> Model:
    # Words that occur once or twice and by chance have gains of one or two: start from what is beyond that.
    strong = np.sign(gain) * np.maximum(np.abs(gain) - 2.5, 0) / 2
    vectors = np.concatenate([np.zeros((1, DIMENSIONS)), rng.normal(0, 0.05, (len(known), DIMENSIONS))])
    vectors[1:, 0] = strong
    model = Model(known, vectors)
    for w in WIDTHS:
        model.filters[w] = rng.normal(0, 0.3 / w, (w, DIMENSIONS, FILTERS))
        model.filters[w][:, 0, : FILTERS // 2] = 1 / w
        model.shifts[w] = np.full(FILTERS, -0.1)
    model.weights = np.tile(np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, 0.0), len(WIDTHS))
    return model


def descend(model: Model, buckets: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Epochs of gradient descent on the texts, in batches of random order."""
    bias = np.array([model.intercept])
    rows = model.rows(buckets)
    adam = Adam(0.02)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            part = np.concatenate([rows[first[d] : first[d + 1]] for d in pick])
            cut = np.concatenate([[0], np.cumsum(np.diff(first)[pick])])
            model.intercept = float(bias[0])
            backward(model, part, cut, labels[pick], adam, bias)
    model.intercept = float(bias[0])
    del model._row


def backward(model: Model, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, adam: Adam, bias: np.ndarray) -> None:
    """One step down the gradient of the logistic loss; only the words at maxima have a share in it."""
    top, place = model.pooled(rows, first)
    act = np.maximum(top, 0)
    error = (sigmoid(act @ model.weights + model.intercept) - labels) / len(labels)
    into = np.outer(error, model.weights) * (top > 0)
    used = np.unique(rows)
    slope = np.zeros((len(used), DIMENSIONS))
    at = np.searchsorted(used, rows)
    for i, w in enumerate(WIDTHS):
        d, p = into[:, i * FILTERS : (i + 1) * FILTERS], place[:, i * FILTERS : (i + 1) * FILTERS]
        change = np.zeros_like(model.filters[w])
        for j in range(w):
            change[j] = np.einsum("nf,nfd->df", d, model.vectors[rows[p + j]])
            for f in range(FILTERS):
                np.add.at(slope, at[p[:, f] + j], d[:, f, None] * model.filters[w][j][:, f][None, :])
        adam.step(("filter", w), model.filters[w], change + 1e-4 * model.filters[w])
        adam.step(("shift", w), model.shifts[w], d.sum(axis=0))
    adam.step("weights", model.weights, act.T @ error + 1e-4 * model.weights)
    adam.step("bias", bias, np.array([error.sum()]))
    touched = used[np.abs(slope).any(axis=1) & (used > 0)]
    model.vectors[touched] -= 0.5 * slope[np.searchsorted(used, touched)]


def calibrate(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray, languages: list[str | None], least: int = 20, count: np.ndarray | None = None) -> dict[str, float]:
    """Threshold of the best F1 by language with at least that many positives, and of all rows under the empty name. count: the rows that each stands for."""

    def best(pick: np.ndarray) -> float:
        order = np.argsort(-scores[pick], kind="stable")
        s, y, w = scores[pick][order], labels[pick][order], weight[pick][order]
        hit, miss = np.cumsum(w * y), np.cumsum(w * (1 - y))
        f1 = 2 * hit / (hit + miss + (w * y).sum())
        i = int(f1.argmax())
        return float(s[i] + s[i + 1]) / 2 if i + 1 < len(s) else float(s[i])

    names = np.array(["" if x is None else x for x in languages], object)
    out = {"": best(np.arange(len(scores)))}
    for name in set(names) - {""}:
        pick = np.flatnonzero(names == name)
        if (labels if count is None else labels * count)[pick].sum() >= least:
            out[name] = best(pick)
    return out


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [word_buckets(buf, offsets) for _, _, buf, offsets in textkit.chunks(*textkit.utf8(texts), CHUNK)]
    return np.concatenate([np.zeros(0, np.int64), *(b for b, _ in parts)]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for _, f in parts)]))]).astype(np.int64)


def dense(model: Model) -> np.ndarray:
    """All parameters but the vectors, in rows as long as a vector."""
    flat = np.concatenate([*(model.filters[w].ravel() for w in WIDTHS), *(model.shifts[w] for w in WIDTHS), model.weights, [model.intercept]])
    return np.concatenate([flat, np.zeros(-len(flat) % DIMENSIONS)]).reshape(-1, DIMENSIONS)


def add_dense(model: Model, change: np.ndarray) -> None:
    at, flat = 0, change.ravel()
    for part in (*(model.filters[w] for w in WIDTHS), *(model.shifts[w] for w in WIDTHS), model.weights):
        part += flat[at : at + part.size].reshape(part.shape)
        at += part.size
    model.intercept += float(flat[at])


def started_by_counts(rows: DataFrame) -> list[Model]:
    """Models of all rows (half, y, text), of those of half 0 and of half 1, before any descent: words of two or more of a model's texts, with their associations."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, first = buckets_of(batch.column("text"))
            pair = np.unique(np.stack([np.repeat(np.arange(batch.num_rows), np.diff(first)), buckets]), axis=1)
            pair = pair[:, pair[1] >= 0]
            kind = (2 * np.asarray(batch.column("half")) + np.asarray(batch.column("y")))[pair[0]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].astype(np.int32)), pa.array(kind.astype(np.int32))], names=["bucket", "kind"])

    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in range(4)]
    texts = rows.select((2 * F.col("half") + F.col("y")).alias("kind")).agg(*kinds).first()
    counts = rows.mapInArrow(words, "bucket int, kind int").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *kinds).filter("n > 1").orderBy("bucket").toArrow()
    bucket = counts.column("bucket").to_numpy().astype(np.int64)
    seen = [counts.column(f"n{k}").to_numpy().astype(float) for k in range(4)]
    out = []
    for halves in ((0, 1), (0,), (1,)):
        n1, positive = sum(seen[2 * h + 1] for h in halves), sum(texts[2 * h + 1] for h in halves)
        n, total = n1 + sum(seen[2 * h] for h in halves), positive + sum(texts[2 * h] for h in halves)
        keep = n >= 2
        out.append(started(bucket[keep], gains(n, n1, total, positive)[keep], np.random.default_rng(0)))
        out[-1].intercept = float(logit(positive / total))
    return out


def packed(part: pa.Table) -> pa.Table:
    """The rows of a share as one: labels, numbers of words and buckets of words."""
    part = part.sort_by("id")
    buckets, first = buckets_of(part.column("text"))
    columns = (np.asarray(part.column("y"), np.int8), np.diff(first).astype(np.int32), buckets.astype(np.int32))
    return pa.table([part.column("share").slice(0, 1), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["share", "y", "sizes", "words"])


def trainer(shared, turn: int, seed: int, names: list[str]):
    """How training on each packed share changes the model of all rows and that of the share's half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column("share")[row].as_py()
                labels, sizes, buckets = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("y", np.int8), ("sizes", np.int32), ("words", np.int32)))
                first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for k in (0, 1 + at % 2):
                    model = copy.deepcopy(shared.value[k])
                    before, other = model.vectors.copy(), dense(model)
                    descend(model, buckets, first, labels.astype(float), SHARE_EPOCHS, np.random.default_rng([seed, turn, at]))
                    moved = np.flatnonzero((model.vectors != before).any(axis=1))
                    change = np.concatenate([model.vectors[moved] - before[moved], dense(model) - other])
                    bucket = np.concatenate([model.buckets[moved - 1], -1 - np.arange(len(other))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(change), k, np.int32)), pa.array(bucket.astype(np.int32)), *(pa.array(c.astype(np.float32)) for c in change.T)], names=["model", "bucket", *names])

    return run


def fit_shares(rows: DataFrame, shares: int, share: float, seed: int = 0) -> Model:
    """A model of all rows (id, text, lang, y), trained in an even number of shares; share is that of positives among all labelled rows."""
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shares)).cast("int")
    rows = rows.select("id", "text", "lang", "y", place.alias("share"), (place % 2).alias("half"))
    models = started_by_counts(rows)
    odds = [m.intercept for m in models]
    context = rows.sparkSession.sparkContext
    names = [f"c{i}" for i in range(DIMENSIONS)]
    shared_rows = materialize(rows.groupBy("share").applyInArrow(packed, "share int, y binary, sizes binary, words binary"), "shares")
    for turn in range(ROUNDS):
        shared = context.broadcast(models)
        changes = shared_rows.mapInArrow(trainer(shared, turn, seed, names), ", ".join(["model int, bucket int", *(f"{c} float" for c in names)]))
        # A word's vector moves by the mean of the shares that changed it.
        means = changes.groupBy("model", "bucket").agg(*(F.avg(c).alias(c) for c in names)).toArrow()
        k, bucket = means.column("model").to_numpy(), means.column("bucket").to_numpy()
        change = np.stack([means.column(c).to_numpy() for c in names], axis=1)
        for i, model in enumerate(models):
            word, other = (k == i) & (bucket >= 0), (k == i) & (bucket < 0)
            model.vectors[1 + np.searchsorted(model.buckets, bucket[word])] += change[word]
            add_dense(model, change[other][np.argsort(-bucket[other])])
        shared.unpersist()
    discard(shared_rows)
    prior = float(logit(share))
    for model, own in zip(models, odds):
        model.intercept += prior - own
    shared = context.broadcast(models)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, first = buckets_of(batch.column("text"))
            half, by = np.asarray(batch.column("half")), [m.score(buckets, first) for m in shared.value[1:]]
            step = np.round(1000 * logit(np.where(half == 0, by[1], by[0]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(step), batch.column("y")], names=["lang", "step", "y"])

    counted = rows.select("text", "lang", "y", "half").mapInArrow(unseen, "lang string, step int, y int").groupBy("lang", "step", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "step", "y").collect()
    step, labels, n = (np.array([r[c] for r in counted], float) for c in ("step", "y", "n"))
    languages = [r["lang"] for r in counted]
    model = models[0]
    move = logit(calibrate(sigmoid(step / 1000), labels, n, languages, count=n)[""])
    model.intercept -= move
    model.thresholds = calibrate(sigmoid(step / 1000 - move), labels, n, languages, count=n)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", one_set: int = ONE_SET, share_rows: int = SHARE, seed: int = 0) -> Model:
    """A model of all labels that are not held out.

    Where an id repeats, its text is that of the least hash. At most one_set texts come to the driver, if that is all.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    near = F.broadcast(usable) if sum(totals.values()) <= MOST_SENT else usable
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).join(near, "id")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("text", "lang", "y"), F.struct(F.xxhash64("text"), "text", "lang")).alias("r")).select("id", "r.*")
    if sum(totals.values()) > one_set:
        rows = materialize(rows, "labelled")
        found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if sum(found.values()) > one_set and len(found) == 2:
            model = fit_shares(rows, 2 * -(-sum(found.values()) // (2 * share_rows)), share, seed)
            discard(rows)
            return model
        if sum(found.values()) > one_set:
            # One label alone: all scores are the share of positives.
            return fit([], np.zeros(0), share, [], seed)
    rows = sorted(rows.collect(), key=lambda r: (str(r["id"]), r["text"]))
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]), share, [r["lang"] for r in rows], seed)


def score_documents(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with score, predicted and flagged (by the threshold of the language)."""
    names = ["score", "predicted", "flagged"]
    plain = boxed(docs, F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), names=[c for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([plain.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("flagged", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.score(*word_buckets(buf, offsets)) for _, _, buf, offsets in textkit.chunks(*textkit.utf8(batch.column(1)), CHUNK)]
            scores = np.concatenate([np.zeros(0), *parts])
            limit = np.array([m.thresholds.get(x or "", m.thresholds.get("", 0.5)) for x in batch.column(2).to_pylist()])
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(scores >= limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *names])

    return plain.mapInArrow(run, schema).select("row.*", *names)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "flagged")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
