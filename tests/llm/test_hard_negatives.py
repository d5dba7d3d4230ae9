import math

import numpy as np
import pytest

from priorframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string, v string"


def brute(rows, anchors, n_positives=5, n_negatives=5, low=80, high=100, scale=256):
    """All anchors against all rows, one at a time, in Python's whole numbers."""
    best = {}
    for i, v, y in rows:
        if None in (i, v, y) or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (y, v)), (y, v))
    vec = {i: (y, [math.floor(scale * x) for x in v]) for i, (y, v) in best.items()}
    out = []
    for a in vec:
        if not anchors(a):
            continue
        score = {i: sum(p * q for p, q in zip(vec[a][1], v)) for i, (_, v) in vec.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if vec[i][0] == vec[a][0]][:n_positives]:
            fits = [i for i in order if vec[i][0] != vec[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:n_negatives])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = H.mine(df, H.F.col("id") % 10 == 0, **options)
    assert out.columns == [c.split()[0] for c in H.RESULT.split(", ")]
    return sorted(tuple(r) for r in out.collect())


def world(n, seed=0, d=6, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0.4, spread, d)], int(rng.integers(0, labels))) for i in range(n)]


def test_equals_brute_force_in_chunks_and_blocks(spark, monkeypatch):
    rows = world(240)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert len(expected) > 100
    assert run(spark, rows) == expected
    monkeypatch.setattr(H, "CHUNK", 7)
    monkeypatch.setattr(H, "ROWS", 11)
    monkeypatch.setattr(H, "ANCHORS", 3)
    assert run(spark, rows) == expected
    assert run(spark, rows, n_positives=3, n_negatives=9, low=50, high=95) == brute(rows, lambda i: i % 10 == 0, 3, 9, 50, 95)


def test_ties_and_repeated_rows(spark):
    """A third of all rows is one vector, some ids repeat with other vectors and labels."""
    rows = world(90, labels=2)
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(60)]
    rows += rows[:30] + [(5, [9.0] * 6, 0), (7, [0.0] * 6, 5)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_rows_that_take_no_part(spark):
    rows = world(40) + [(None, [1.0] * 6, 0), (100, None, 0), (110, [1.0] * 6, None), (120, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (130, [float("nan")] * 6, 1), (140, [float("inf")] + [1.0] * 5, 1)]
    found = run(spark, rows)
    assert found == brute(rows, lambda i: i % 10 == 0)
    assert not {r[0] for r in found} & {100, 110, 120, 130, 140}


def test_lengths_and_large_values(spark):
    short = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0, 3.0], 0), (2, [0.9, 2.0], 1), (3, [], 1), (4, [], 0)]
    assert [r[:4] for r in run(spark, short)] == [(0, 1, 1, 2), (0, 4, 1, 3)]
    large = [(0, [1.0, 1.0], 0), (1, [3e7 + 1, 1.0], 0), (2, [3e7, 1.0], 1), (3, [1e300, 0.0], 1), (10, [1e300, 1.0], 1)]
    out = run(spark, large)
    assert (0, 1, 1, 2) in {r[:4] for r in out} and all(abs(r[5]) <= H.LIMIT for r in out)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []


@pytest.mark.parametrize("same", [True, False])
def test_combiner_keeps_the_best_of_each_slot(same):
    rng = np.random.default_rng(3)
    ids, labels, v = np.arange(200), rng.integers(0, 2, 200), rng.integers(-5, 6, (200, 3)).astype(float)
    limits = np.array([[40, 20, H.NO_SCORE]] * 4)
    slots = H.Slots(ids[:4], labels[:4], v[:4], limits, np.full(4, -15), same, 4)
    for i in range(0, 200, 33):
        slots.add(ids[i : i + 33], labels[i : i + 33], v[i : i + 33])
    got = [tuple(x.values()) for x in slots.batch().to_pylist()]
    expected = []
    for a in range(4):
        s = (v @ v[a]).astype(int)
        for j, (top, low) in enumerate([(40, 21), (20, -15)]):
            fits = [(-s[i], i) for i in range(200) if low <= s[i] <= top and (labels[i] == labels[a]) == same and i != a]
            expected += [(a, j, -x, i) for x, i in sorted(fits)[:4]]
    assert got == expected


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in H.op12_hard_negatives(spark, sf).collect()) == sorted(db.execute(H.SQL_12).fetchall())
