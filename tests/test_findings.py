"""Cases that larger tables have brought up."""

import collections
import datetime as dt
import functools
import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from priorframe.operators import aggregates
from priorframe.queries import load
from priorframe.streaming import stateful as S


def test_weights_of_zero_have_no_mean(spark):
    rows = [(1, 40.0, 0.0), (2, None, 0.0), (3, 40.0, 0.0), (3, 50.0, 2.0), (4, 40.0, 0.0), (4, None, 2.0), (5, 40.0, 3.0), (5, None, 1.0), (6, 40.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, w double")
    got = {r.k: r.mean for r in aggregates.weighted_cover_mean(df, ["k"], "x", "w").collect()}
    assert math.isnan(got.pop(1))  # as in SQL: zero over zero, which is above any least share
    assert got == {2: None, 3: 50.0, 4: None, 5: 40.0, 6: None}


def test_a_cover_of_just_half_does_not_hang_on_the_order_of_addition(spark, tmp_path):
    """Covered and other weights are equal in decimals: which sum is larger in floating point is that of the order of the log."""
    start, parts = dt.datetime(2024, 1, 1), ((0.1, 50), (0.2, 60), (0.7, 50), (0.3, 1), (0.7, 2))
    rows = [(5 * u + i, start + dt.timedelta(minutes=u), u, "view", v, f'{{"k": {k}}}') for u, p in enumerate(itertools.permutations(parts)) for i, (v, k) in enumerate(p)]
    df = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for u, p in enumerate(itertools.permutations(parts)):
        add = lambda xs: functools.reduce(float.__add__, xs)
        covered, whole = add(v for v, k in p if k >= 40), add(v for v, k in p)
        want[u] = pytest.approx(add(k * v for v, k in p if k >= 40) / covered, abs=1e-6) if covered / whole >= 0.5 else None
    assert 0 < sum(x is None for x in want.values()) < len(want)
    assert {r.entity: r.mean for r in load()[0]["weighted_cover_mean"](spark, str(tmp_path)).collect()} == want


def test_bins_by_quantile_do_not_hang_on_the_order_of_addition(spark, tmp_path):
    """Equal sums in many orders, in many files that run against the order of the log."""
    start, values = dt.datetime(2024, 1, 1), (0.1, 0.2, 0.3, 0.7)
    rows = [(4 * u + i, start + dt.timedelta(minutes=4 * u + i), u, "view", v, '{"k": 1}') for u, p in enumerate(itertools.islice(itertools.cycle(itertools.permutations(values)), 101)) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    sums = sorted(functools.reduce(float.__add__, (r[4] for r in rows if r[2] == u), 0.0) for u in range(101))
    assert len(set(sums)) > 1
    edges = [sums[10 * i] for i in range(1, 10)]
    want = collections.Counter(sum(v > e for e in edges) for v in sums)
    assert {r.bin: r.n for r in load()[0]["equal_count_bins_quantile"](spark, str(tmp_path)).collect()} == want


def test_quantile_edges_between_neighbours_in_the_last_bit(spark, tmp_path):
    """Sums that differ in the last bit alone: an edge between two of them is the one that the SQL takes."""
    start, rows = dt.datetime(2024, 1, 1), []
    for low in (18.78, 55.94, 100.23, 156.43, 263.84):
        for _ in range(8):
            rows.append((len(rows), start + dt.timedelta(minutes=len(rows)), len(rows), "view", low, '{"k": 1}'))
            low = math.nextafter(low, math.inf)
    found, want = {}, {}
    for n in range(31, 41):
        path = f"{tmp_path}/{n}/events.parquet"
        spark.createDataFrame(rows[:n], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(path)
        found[n] = sorted(map(tuple, load()[0]["equal_count_bins_quantile"](spark, f"{tmp_path}/{n}").collect()))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        want[n] = sorted(db.execute(load()[1]["equal_count_bins_quantile"]).fetchall())
    assert found == want


def test_many_groups_are_settled_in_few_calls(spark):
    """A group costs no call of its own: 6,000 groups of one cut-off in no more states than buckets; null actors are actors."""
    day = dt.datetime(2024, 1, 1)
    rows = [(3 * g + i, g, day + dt.timedelta(hours=1 + i), a, False) for g in range(6000) for i, a in enumerate((None, 5, None if g % 2 else 6))]
    schema = "id long, game long, ts timestamp, actor long, ended boolean"
    frames = [spark.createDataFrame(r, schema).withColumn("cutoff", F.lit(day + dt.timedelta(hours=20)).cast("timestamp")) for r in (rows, [(99999, 1, day + dt.timedelta(hours=3, minutes=30), 7, False)])]
    started = []

    def start(stream, state):
        started.append(S.into_table(S.settle(stream, ["game"], "actor", "ts", "id", "ended", "cutoff", "1 hour"), state))
        return started[-1]

    state = S.replay(frames, "test", start)
    got = spark.read.parquet(f"{state}-table").groupBy("actor", "reason").agg(F.count_distinct("game").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert sorted(map(tuple, got), key=str) == [(None, "relieved", 6000, 6000)]
    assert 0 < started[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= 32
