"""Attacks on the as-of operators: brute force, later rows, same-day rows, own row, row order, the last prior day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from priorframe.operators import asof

SCHEMA = "entity int, day date, game int, n long, s long, v double"


def league(seed=7):
    rng = random.Random(seed)
    rows = []
    for game in range(400):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
        n = rng.randint(0, 9)
        rows.append((rng.randrange(8), day, game, n, rng.randint(0, n), rng.choice([None, rng.random()])))
    return rows


def prior(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = asof.prior_sums(df, ["entity"], ["day", "game"], ["n", "s"])
    out = asof.prior_mean_std(out, ["entity"], ["day", "game"], "v")
    out = asof.rolling_prior(out, ["entity"], ["day", "game"], "n", 5, "mean5")
    return {r.game: r for r in out.collect()}


def days(spark, rows):
    out = asof.prior_day_totals(spark.createDataFrame(rows, SCHEMA), ["entity"], "day", ["n", "s"])
    return {(r.entity, r.day): (r.prior_n, r.prior_s) for r in out.collect()}


def test_brute_force(spark):
    rows = league()
    got, by_day = prior(spark, rows), days(spark, rows)
    for e, d, g, *_ in rows:
        before = sorted(r for r in rows if r[0] == e and (r[1], r[2]) < (d, g))
        assert (got[g].prior_n, got[g].prior_s) == (sum(r[3] for r in before), sum(r[4] for r in before))
        known = [r[5] for r in before if r[5] is not None]
        assert got[g].prior_mean == (pytest.approx(sum(known) / len(known), abs=1e-9) if known else None)
        assert (got[g].prior_std is None) == (len(known) < 2)
        last = [r[3] for r in before[-5:]]
        assert got[g].mean5 == (pytest.approx(sum(last) / len(last), abs=1e-9) if len(last) >= 2 else None)
        strict = [r for r in rows if r[0] == e and r[1] < d]
        assert by_day[(e, d)] == (sum(r[3] for r in strict), sum(r[4] for r in strict))


def test_later_rows_change_nothing(spark):
    rows = league()
    cut = dt.date(2024, 2, 1)
    moved = [(e, d, g, n * 7 + 1, s * 3, 0.5) if d >= cut else (e, d, g, n, s, v) for e, d, g, n, s, v in rows]
    a, b = prior(spark, rows), prior(spark, moved)
    for e, d, g, *_ in rows:
        if d < cut:
            assert a[g] == b[g]


def test_same_day_rows_do_not_leak_into_days(spark):
    rows = league()
    day = rows[0][1]
    moved = [(e, d, g, n + 50 if d == day else n, s, v) for e, d, g, n, s, v in rows]
    a, b = days(spark, rows), days(spark, moved)
    assert all(a[k] == b[k] for k in a if k[1] <= day)
    assert any(a[k] != b[k] for k in a if k[1] > day)


def test_row_order_does_not_matter_and_last_day_counts(spark):
    rows = league()
    assert prior(spark, rows) == prior(spark, rows[::-1])
    one = [(1, dt.date(2024, 1, 1), 1, 5, 2, 0.1), (1, dt.date(2024, 1, 2), 2, 3, 1, 0.2)]
    assert days(spark, one)[(1, dt.date(2024, 1, 2))] == (5, 2)


def test_point_state_keeps_other_games_of_the_day(spark):
    d = dt.date(2024, 1, 5)
    df = spark.createDataFrame([(1, d, 1, 4, 1, 0.0), (1, d, 2, 6, 2, 0.0), (1, dt.date(2024, 1, 6), 3, 1, 0, 0.0)], SCHEMA)
    loose = {r.game: r.prior_n for r in asof.asof_point(df, ["game"], "entity", "day", ["n"]).collect()}
    strict = {r.game: r.prior_n for r in asof.asof_point(df, ["game"], "entity", "day", ["n"], strict_day=True).collect()}
    assert loose == {1: 6, 2: 4, 3: 10} and strict == {1: 0, 2: 0, 3: 10}


def test_calendar_windows_count_days(spark):
    rows = league()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.col("n").cast("double"))
    plain = {r.game: r.w for r in asof.calendar_window(df, ["entity"], "day", "x", 15, "w").collect()}
    same = {r.game: r.w for r in asof.calendar_window(df, ["entity"], "day", "x", 15, "w", ["game"]).collect()}
    for e, d, g, *_ in rows:
        near = sum(r[3] for r in rows if r[0] == e and 1 <= (d - r[1]).days <= 15)
        assert plain[g] == near and same[g] == near + sum(r[3] for r in rows if r[0] == e and r[1] == d and r[2] < g)


def test_plans_stay_in_the_jvm_and_partition_by_entity(spark):
    df = spark.createDataFrame(league(), SCHEMA)
    plan = asof.prior_sums(df, ["entity"], ["day", "game"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
