import zlib

import numpy as np
import pyarrow as pa
import pytest

from priorframe.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int"


def world(n=600, seed=1):
    rng = np.random.default_rng(seed)
    bad = ["vile", "scum", "hätlich"]
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(0, 3000)}" for _ in range(rng.integers(5, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        docs.append((i, " ".join(words), ["en", "de", None][i % 3], "clash"))
        labels.append((i, 1, toxic))
    return docs, labels


def run(spark, docs, labels):
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    return X.score_documents(d, X.train(d, y))


def test_held_out_accuracy_on_a_made_world(spark):
    docs, labels = world()
    extra = [(9000, None, None, ""), (9001, "", "en", ""), (9002, "vile", "en", ""), (9003, "w1 " * 30000 + "scum", "de", ""), (9003, "w1 " * 30000 + "scum", "de", ""), (None, "scum of all", "xx", "")]
    out = run(spark, docs + extra, labels + [(9100, 1, None), (None, 1, 1)])
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted", "flagged"]
    rows = out.collect()
    assert len(rows) == len(docs) + len(extra)
    held = [(r.predicted, dict((i, t) for i, _, t in labels)[r.doc_id]) for r in rows if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.93
    by = {r.doc_id: r for r in rows}
    assert by[9002].predicted == by[9003].predicted == by[None].predicted == 1 and by[9000].score == by[9001].score < 0.5
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sorted(r.score for r in rows) == sorted(r.score for r in run(spark, docs + extra, labels).collect())


def test_score_depends_on_the_text_alone(spark):
    docs, labels = world(200)
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = X.train(d, y)
    a = {r.doc_id: r.score for r in X.score_documents(d, model).collect()}
    moved = spark.createDataFrame([(i + 10_000, t, "zz", s) for i, t, _, s in docs[::-1]], SCHEMA)
    assert {r.doc_id - 10_000: r.score for r in X.score_documents(moved, model).collect()} == pytest.approx(a, rel=1e-5)


def test_held_out_rows_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in X.op10_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out]) > 0.9


def test_one_class_no_labels_and_empty_table(spark):
    docs, labels = world(20)
    ones = run(spark, docs, [(i, 1, 0) for i, _, _ in labels]).collect()
    assert {r.predicted for r in ones} == {0}
    assert len(run(spark, docs, []).collect()) == 20
    assert run(spark, [], labels).collect() == []


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """In shares: no text comes to the driver, words of every text are counted, and held-out rows are told apart."""
    docs, labels = world(900)
    monkeypatch.setattr(X, "fit", lambda *_: pytest.fail("fitted on the driver"))
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = X.train(d, y, one_set=200, share_rows=120)
    learned = [t for i, t, _, _ in docs if zlib.crc32(str(i).encode()) % 5 != 0]
    buckets, first = X.buckets_of(pa.array(learned))
    pair = np.unique(np.stack([buckets, np.repeat(np.arange(len(learned)), np.diff(first))]), axis=1)
    known, n = np.unique(pair[0][pair[0] >= 0], return_counts=True)
    assert model.buckets.tolist() == known[n > 1].tolist()
    truth = {i: t for i, _, t in labels}
    held = [r.predicted == truth[r.doc_id] for r in X.score_documents(d, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean(held) > 0.93


def test_repeated_ids_give_one_text(spark, monkeypatch):
    """An id on many rows is one text of the sample, whatever the order of the rows."""
    docs, labels = world(60)
    seen = []
    monkeypatch.setattr(X, "fit", lambda texts, y, *rest: seen.append((texts, y.tolist())))
    d, y = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    X.train(d, y)
    again = spark.createDataFrame([(i, t, lang, s) for i, t, lang, s in docs for _ in range(5)], SCHEMA).repartition(7)
    X.train(again, y)
    assert seen[0] == seen[1] and len(seen[0][0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    model = X.Model(np.arange(5), rng.normal(size=(6, X.DIMENSIONS)))
    for w in X.WIDTHS:
        model.filters[w], model.shifts[w] = rng.normal(size=(w, X.DIMENSIONS, X.FILTERS)), rng.normal(size=X.FILTERS)
    model.weights, model.intercept = rng.normal(size=X.FILTERS * len(X.WIDTHS)), 0.3
    return model, rng.integers(0, 6, 14), np.array([0, 4, 7, 14])


def forward(model, rows, first):
    """Maxima of all filters, one text, filter and position at a time."""
    out = []
    for a, b in zip(first, first[1:]):
        tops = [max(sum(float(model.vectors[rows[p + j]] @ model.filters[w][j][:, f]) for j in range(w)) for p in range(a, b - w + 1)) + model.shifts[w][f] for w in X.WIDTHS for f in range(X.FILTERS)]
        out.append(tops)
    return np.array(out)


def test_forward_pass_equals_a_loop():
    model, rows, first = small_model()
    expected = forward(model, rows, first)
    assert np.allclose(model.pooled(rows, first)[0], expected, atol=1e-5) and np.allclose(model.top(rows, first), expected, atol=1e-5)


def test_backward_pass_equals_finite_differences():
    model, rows, first = small_model()
    labels, seen = np.array([1.0, 0.0, 1.0]), {}

    class Record:
        def step(self, name, value, slope):
            seen[name] = slope.copy()

    def loss():
        p = X.sigmoid(np.maximum(forward(model, rows, first), 0) @ model.weights + model.intercept)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    def slope_at(array, at, eps=1e-5):
        array[at] += eps
        up = loss()
        array[at] -= 2 * eps
        down = loss()
        array[at] += eps
        return (up - down) / (2 * eps)

    before = model.vectors.copy()
    X.backward(model, rows, first, labels, Record(), np.zeros(1))
    vectors = (before - model.vectors) / 0.5
    model.vectors[:] = before
    for w in X.WIDTHS:
        for at in [(0, 0, 0), (w - 1, 3, 2), (w // 2, 7, 5)]:
            assert seen[("filter", w)][at] - 1e-4 * model.filters[w][at] == pytest.approx(slope_at(model.filters[w], at), abs=1e-4)
        assert seen[("shift", w)][1] == pytest.approx(slope_at(model.shifts[w], 1), abs=1e-4)
    assert seen["weights"][4] - 1e-4 * model.weights[4] == pytest.approx(slope_at(model.weights, 4), abs=1e-4)
    for at in [(1, 0), (3, 5), (5, 7)]:  # row 0 is the unknown word, which is not trained
        assert vectors[at] == pytest.approx(slope_at(model.vectors, at), abs=1e-4)
    assert (vectors[0] == 0).all()
