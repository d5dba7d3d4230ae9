import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priorframe.llm import quality_classifier as Q
from priorframe.llm import textkit

SCHEMA = "doc_id long, text string, lang string, score string, `a.b` int, row string"
LABELS = "doc_id long, quality int, toxic int"


def world(n=500, seed=1):
    """Good texts, and bad ones that shout, repeat or are full of symbols."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rng.integers(0, 26))}{chr(97 + rng.integers(0, 26))}en" for _ in range(rng.integers(5, 90))]
        good = int(rng.random() < 0.8)
        if not good:
            kind = rng.integers(0, 3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w + "$$$ |" for w in words]
        docs.append((i, " ".join(words) + ".", "en", "clash", i, "clash"))
        labels.append((i, good, 0))
    return docs, labels


def run(spark, docs, labels):
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    return Q.score_documents(d, Q.train(d, y))


def test_held_out_accuracy_on_a_made_world(spark):
    docs, labels = world()
    extra = [(9000, None, "", "", 1, ""), (9001, "", "", "", 1, ""), (9002, "wxyen " * 30000, "", "", 1, ""), (None, "WAXEN!! " * 20, "", "", 1, ""), (3, docs[3][1], "", "", 1, "")]
    out = run(spark, docs + extra, labels + [(9100, None, 1), (None, 1, 1)])
    assert out.columns == ["doc_id", "text", "lang", "a.b", "row", "score", "strength", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: y for i, y, _ in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[9000].score == by[9001].score and by[9002].predicted == by[None].predicted == 0
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    again = run(spark, docs[::-1], labels[::-1])
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({i: by[i].score for i in truth}, rel=1e-6)


def test_all_labelled_rows_are_learned_from(spark):
    """In shares: each document is in one (a rare kind in several of its half), and held-out ones are told apart."""
    docs, labels = world(700)
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    rows = d.select(F.col("doc_id").cast("string").alias("id"), "text").join(y.select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") > 0).alias("good")), "id")
    totals = {good: sum(q == good for _, q, _ in labels) for good in (True, False)}
    for of, copies in ((totals, 1), ({True: totals[True], False: 10}, 4)):
        dealt = Q.dealt(rows, of, 8, 0).collect()
        assert {r.id for r in dealt} == {str(i) for i, _, _ in labels} and {r.share for r in dealt} == set(range(8))
        assert all(r.share % 2 == r.half for r in dealt) and len({(r.id, r.share) for r in dealt}) == len(dealt)
        assert max(sum(r.id == str(i) for r in dealt) for i, q, _ in labels if not q) == copies
    model = Q.train(d, y, share_rows=100)
    truth = {i: q for i, q, _ in labels}
    scored = Q.score_documents(d, model).collect()
    held = [r.predicted == truth[r.doc_id] for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean(held) > 0.95
    again = Q.train(spark.createDataFrame(docs[::-1] * 2, SCHEMA), y, share_rows=100)
    assert again.weights == pytest.approx(model.weights, abs=1e-9) and again.cut == pytest.approx(model.cut, abs=1e-9)


def test_held_out_rows_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op13_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b, _ in held]) > 0.93
    good, bad = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.95


def test_one_class_no_labels_and_empty_tables(spark):
    docs, labels = world(20)
    assert {(r.score, r.predicted) for r in run(spark, docs, [(i, 1, 0) for i, _, _ in labels]).collect()} == {(1.0, 1)}
    assert {(r.score, r.predicted) for r in run(spark, docs, [(i, 0, 0) for i, _, _ in labels]).collect()} == {(0.0, 0)}
    assert {r.score for r in run(spark, docs, []).collect()} == {0.7}
    assert run(spark, [], labels).collect() == []


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    w, d = rng.normal(size=7), rng.normal(size=(30, 7))
    loss, slope = Q.pair_loss(w, d)
    plain = np.mean([np.log(1 + np.exp(-float(x @ w))) for x in d]) + Q.DECAY / 2 * float(w @ w)
    assert loss == pytest.approx(plain)
    for i in range(7):
        e = np.eye(7)[i] * 1e-6
        assert slope[i] == pytest.approx((Q.pair_loss(w + e, d)[0] - Q.pair_loss(w - e, d)[0]) / 2e-6, abs=1e-7)


def test_strengths_of_a_known_ranking_are_found():
    """Preferences drawn from the model itself: fitted strengths order documents as the true ones."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, Q.WIDTH)) * (np.arange(Q.WIDTH) < 5)
    truth = x[:, :5] @ np.array([2.0, -1.0, 0.5, 0, 0])
    model = Q.rank_pairs(x, truth + rng.logistic(size=400) * 0.3 > 0, 0)
    assert np.corrcoef(model.strength(x), truth)[0, 1] > 0.97


def test_quantile_cut_has_the_share_below():
    s, w = np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0, 1.0])
    assert [Q.quantile_cut(s, w, q) for q in (0.25, 0.5, 0.75)] == [1.5, 2.5, 3.5]
    assert Q.quantile_cut(s, np.array([1.0, 3.0, 1.0, 1.0]), 0.5) == 1.5


def plain_features(text):
    """The shares, one text at a time."""
    words = [w for line in [text] for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", line)]
    n = max(len(words), 1)
    letters = [b for b in text.encode() if chr(b).isalpha() and b < 128 or b >= 128]
    size = max(sum(len(w.encode()) for w in words), 1)
    low = [w.encode().lower() for w in words]
    pairs = list(zip(low, low[1:]))
    lines = [x.strip(" \t\x0b\x0c\r") for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    has = lambda w, marks: any(c in marks for c in w)
    return {
        "no_letter": sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words) / n,
        "symbol": sum(has(w, "#*$%&|<>") for w in words) / n, "shout": sum(w[-1] == "!" for w in words) / n, "stop": sum(w[-1] in ".!?" for w in words) / n,
        "upper": sum(65 <= b <= 90 for b in text.encode()) / max(len(letters), 1), "digit": sum(c in "0123456789" for c in text) / size,
        "mark": sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) / size, "same_as_last": sum(a == b for a, b in pairs) / n,
        "repeated_pairs": (len(pairs) - len(set(pairs))) / max(len(words) - 1, 1), "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
    }


def test_features_equal_a_plain_loop():
    texts = ["", "One two TWO two! 3 | $x.", " \n a b\na b\r\n\n a b \nc?", None, "é É\té", "x", "\n", "SHOUT!! SHOUT!! SHOUT!!"]
    got = np.concatenate([Q.features(b, o) for _, _, b, o in textkit.chunks(*textkit.utf8(pa.array(texts)), 16)])
    whole = Q.features(*textkit.utf8(pa.array(texts)))
    assert np.allclose(got, whole)
    for row, text in zip(whole, texts):
        expected = plain_features(text or "")
        assert {s: row[Q.SHAPES.index(s)] for s in Q.SHARES} == pytest.approx(expected)
        assert row[len(Q.SHAPES) :] @ row[len(Q.SHAPES) :] == pytest.approx(1.0 if (text or "").split() else 0.0)
