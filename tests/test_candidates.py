"""Candidate features hold nothing of their own day or of later ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorframe.functions import context as X
from priorframe.plans import candidates as C
from priorframe.queries import candidates as Q

DAY = dt.date(2024, 3, 1)
SCHEMA = "event_id long, ts timestamp, entity long, day date, kind string, value double, k int, success int, swing int"


def world(n=900, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        day = DAY + dt.timedelta(days=i * 40 // n)
        kind = str(rng.choice(["view", "error", "purchase", "click"]))
        rows.append((i, dt.datetime.combine(day, dt.time()) + dt.timedelta(seconds=i), int(rng.integers(0, 4)), day, kind, float(rng.integers(0, 100)), int(rng.integers(0, 30)), int(kind == "purchase"), int(kind != "view")))
    return rows


def test_later_days_change_no_row(spark):
    """Days from a boundary on are altered and cut off: the rows up to it, its own included, stay what they were."""
    rows, edge = world(), DAY + dt.timedelta(days=21)
    names = list(Q.CANDIDATES.features)
    build = lambda log: Q.CANDIDATES.apply(Q.candidates(spark.createDataFrame(log, SCHEMA))).filter(F.col("day") <= edge).select("entity", "day", *names)
    whole = {(r.entity, r.day): r for r in build(rows).collect()}
    altered = [r if r[3] < edge else (*r[:4], "purchase", 100 - r[5], r[6], 1, 0) for r in rows]
    cut = [r for r in altered if r[3] <= edge]
    assert len(whole) > 60 and any(whole[k].fade is not None for k in whole)
    for other in (altered, cut):
        got = {(r.entity, r.day): r for r in build(other).collect()}
        assert got == whole


def test_habits_of_a_small_log(spark):
    """One entity, one day a row list: every column by hand."""
    h = C.Habits(F.col("done"), F.col("hit"), F.col("zone"), F.col("first"), F.col("good"), F.col("spin"), F.col("ext"))
    g = C.Gates(zone=2, first=2, decay=4, measure=3, debut=3, full=2, early=1, late=(2, 3), days=5)
    t = lambda d, i, done, hit, zone, spin: (1, DAY + dt.timedelta(days=d), i, done, hit, zone, i == 0, True, spin, spin)
    rows = [t(0, 0, True, True, True, 10.0), t(0, 1, True, False, None, None), t(0, 2, False, False, False, 20.0), t(3, 0, True, True, True, None), t(9, 0, True, False, True, 40.0), t(9, 1, True, True, True, 60.0), t(12, 0, True, False, True, 99.0)]
    log = spark.createDataFrame(rows, "entity long, day date, i int, done boolean, hit boolean, zone boolean, first boolean, good boolean, spin double, ext double")
    got = {(r.day - DAY).days: r for r in C.habit_state(C.habit_days(log, "entity", ["day"], ["i"], h, g), "entity", "day", g).collect()}
    first = got[0]
    assert (first.zone_share, first.units, first.is_debut, first.rest, first.prior_load, first.extension) == (None, 0, True, None, None, None)
    assert (got[3].zone_share, got[3].first_share, got[3].prior_load, got[3].rest, got[3].units) == (0.5, None, 3, 3, 2)
    last = got[12]
    assert (last.zone_share, last.first_share, last.prior_load, last.rest, last.units, last.is_debut) == (0.8, 1.0, 2, 3, 5, False)
    assert (last.spin_recent, last.spin_delta, last.extension) == (50.0, 35.0, 32.5)
    assert (last.early_rate, last.late_rate, last.decay) == (pytest.approx(2 / 3), 0.5, pytest.approx(0.5 - 2 / 3))


def test_opponents_last_games(spark):
    """The last two games in which a member had a unit, and members without history."""
    d = lambda n: DAY + dt.timedelta(days=n)
    rows = [(d(0), 7, 1, 0, True, True), (d(1), 7, 1, 1, False, True), (d(2), 7, 1, 2, True, False), (d(3), 7, 1, 3, True, False), (d(4), 7, 1, 4, True, True), (d(4), 7, 2, 5, True, True)]
    log = spark.createDataFrame(rows, "day date, side int, member int, i int, done boolean, hit boolean")
    got = {(r.day - DAY).days: r for r in C.opponents_form(log, ["day"], "side", "member", "i", F.col("done"), F.col("hit"), 2, 1, 2).collect()}
    assert [got[n].recent_rate for n in range(5)] == [None, 1.0, 1.0, 0.5, 0.0]
    assert (got[4].n_new, got[4].n_slots, got[0].n_new) == (1, 2, 1)


def test_context_scores(spark):
    one = lambda *columns: spark.range(1).select(*columns).first()
    n = F.lit(None).cast("double")
    assert one(X.blowout_risk(F.lit(-3.0), F.lit(12.0)), X.blowout_risk(n, F.lit(9.0)), X.blowout_risk(F.lit(9.0), F.lit(20.0)))[:] == (1.0, None, 1.0)
    assert one(X.grip_penalty(F.lit(20.0)), X.grip_penalty(F.lit(90.0)), X.grip_penalty(n))[:] == (pytest.approx(-0.003), 0.0, 0.0)
    assert one(X.eastward_hours(F.lit(-8), F.lit(-5)), X.eastward_hours(F.lit(-5), F.lit(-8)), X.eastward_hours(n, F.lit(-8)), X.travel_fatigue(F.lit(-8), F.lit(-5)))[:] == (3, 0, 0, pytest.approx(0.45))
    assert one(X.adjusted_to_zone(F.lit(2)), X.adjusted_to_zone(n), X.second_game(F.lit(2)), X.second_game(n))[:] == (False, True, True, False)
    assert one(X.month_factor(F.lit("2024-09-30").cast("date")), X.month_factor(F.lit("2024-12-01").cast("date")), X.official_age(F.lit(1980), F.lit(2026)))[:] == (0.97, 1.0, 46.0)


def test_ladder_divergence(spark):
    pmf = F.expr("array(0.5D, 0.3D, 0.2D)")
    got = spark.range(1).select(X.ladder_divergence(pmf, F.expr("array(1, 9)"), F.expr("array(-100, 300)")).alias("x"), X.ladder_divergence(pmf, F.expr("CAST(array() AS array<int>)"), F.expr("CAST(array() AS array<int>)")).alias("none")).first()
    gaps = np.array([0.5 - 0.5, 0 - 0.25])
    assert got["x"]["spread"] == pytest.approx(gaps.std()) and got["x"]["widest"] == pytest.approx(-0.25) and got["none"] is None
