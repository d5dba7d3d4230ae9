import numpy as np
import pytest

from priorframe.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes, weights=M.WEIGHTS, cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in capped}
        capped |= over


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return M.op7_source_mix(spark, str(tmp_path)).collect()


def test_targets_totals_and_reruns(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        source = [None, "a", "b", "Z", "ä", "tiny"][min(int(rng.integers(0, 9)), 5) if i % 60 else 5] if i % 97 else "tiny"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 200))), source, "clash"))
    rows += [(5000, None, "a", ""), (5001, "", "empty", ""), (None, "x y", "a", ""), (7, "same", "b", ""), (7, "same", "b", "")]
    got = run(spark, rows, tmp_path)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 400
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, run(spark, rows[::-1], tmp_path)))


def test_many_blocks_fly_to_a_few_units(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "s", int(rng.integers(0, 300)), 1, 4000, 0.37) for i in range(4000)]
    units = spark.createDataFrame(rows, "id long, source string, size long, n_rows long, n_units long, x double")
    got = M.sample_copies(units, block=100, merge=4).toPandas()
    assert set(got["x"]) <= {0.0, 1.0} and len(got) == 4000
    assert abs((got["x"] * got["size"]).sum() - 0.37 * got["size"].sum()) < 300
    assert abs(got["x"].sum() - 0.37 * 4000) <= 3


def test_flight_keeps_probabilities():
    totals = np.stack([np.ones(7), np.array([3.0, 1, 4, 1, 5, 9, 2])])
    x = np.array([0.2, 0.5, 0.5, 0.9, 0.1, 0.4, 0.0])
    runs = np.array([M.flight(x, totals, np.random.default_rng(i)) for i in range(4000)])
    assert np.allclose(runs @ totals.T, x @ totals.T)
    assert np.abs(runs.mean(axis=0) - x).max() < 0.04


def test_documents_taken_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = M.mix_documents(docs)
    assert out.columns == [*docs.columns, "mix_copies"]
    rows = out.collect()
    assert rows and all(1 <= r.mix_copies <= 3 for r in rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
