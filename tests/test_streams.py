"""Streams with state: replays in any number of triggers equal the batch, state goes, late rows are counted."""

import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorframe.streaming import stateful as S

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def test_settlements_of_a_group():
    ms = lambda **actors: {a: (t, i) for i, (a, t) in enumerate(actors.items())}
    assert S.settlements({}, 5) == {}
    assert S.settlements(ms(a=1), None) == {}
    assert S.settlements(ms(a=1, b=3, c=3), None) == {"a": (3, "relieved"), "b": (3, "relieved")}
    # An end before an actor's first appearance counts from that on; at a tie the later actor is the reason.
    assert S.settlements(ms(a=1, b=9), 4) == {"a": (4, "terminal"), "b": (9, "terminal")}
    assert S.settlements(ms(a=1, b=4), 4)["a"] == (4, "relieved")


def world(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        minutes = int(rng.integers(0, 3 * 24 * 60))
        rows.append((i, int(rng.integers(0, 6)), START + dt.timedelta(minutes=minutes), int(rng.integers(0, 5)), bool(rng.random() < 0.05)))
    return sorted(rows, key=lambda r: r[2])


def expected(rows, delay_hours):
    """Settlements of all groups (game, day) with a cut-off six hours into the next day, up to the final watermark."""
    end = max(r[2] for r in rows) - dt.timedelta(hours=delay_hours)
    groups = {}
    for i, game, ts, actor, ended in rows:
        groups.setdefault((game, ts.date()), []).append((ts, i, actor, ended))
    out = set()
    for (game, day), own in groups.items():
        cutoff = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=20)
        own = [x for x in own if x[0] < cutoff]
        first, over = {}, min([x[0] for x in own if x[3]], default=None)
        for ts, i, actor, _ in sorted(own):
            first.setdefault(actor, (ts, i))
        for actor, (ts, i) in first.items():
            later = min([t for a, t in first.items() if t > (ts, i)], default=None)
            options = ([(later[0], "relieved")] if later else []) + ([(max(ts, over), "terminal")] if over else [])
            at, why = min(options, default=(cutoff, "expired"))
            if at < end:
                out.add((game, day, actor, int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1000), why))
    return out


@pytest.mark.parametrize("split", ["one", "three", "late"])
def test_settled_rows_are_those_of_the_batch(spark, split):
    rows = world()
    parts = [rows] if split == "one" else [rows[:90], rows[90:140], rows[140:]]
    if split == "late":  # rows out of order, but by less than the delay
        parts[0], parts[1] = rows[:60] + rows[70:90], rows[60:70] + rows[90:140]
    frames = [spark.createDataFrame(p, "id long, game long, ts timestamp, actor long, ended boolean").withColumn("day", F.to_date("ts")).withColumn("cutoff", F.col("day").cast("timestamp") + F.expr("INTERVAL 20 HOURS")) for p in parts]
    started = []

    def start(stream, state):
        started.append(S.into_table(S.settle(stream, ["game", "day"], "actor", "ts", "id", "ended", "cutoff", "8 hours"), state))
        return started[-1]

    state = S.replay(frames, "test", start)
    got = [tuple(r) for r in spark.read.parquet(f"{state}-table").select("game", "day", "actor", "at", "reason").collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, 8)
    # Groups whose cut-off is over have no state left: only the last day's can be kept.
    left = started[-1].lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= len({r[1] for r in rows}) * 2


def test_state_goes_after_the_cut_off(spark):
    rows = [(0, 1, START, 7, False), (1, 2, START + dt.timedelta(days=9), 8, False)]
    frames = [spark.createDataFrame([r], "id long, game long, ts timestamp, actor long, ended boolean").withColumn("day", F.to_date("ts")).withColumn("cutoff", F.col("day").cast("timestamp") + F.expr("INTERVAL 20 HOURS")) for r in rows]
    started = []

    def start(stream, state):
        started.append(S.into_table(S.settle(stream, ["game", "day"], "actor", "ts", "id", "ended", "cutoff", "1 hour"), state))
        return started[-1]

    state = S.replay(frames, "test", start)
    assert [(r.game, r.actor, r.reason) for r in spark.read.parquet(f"{state}-table").collect()] == [(1, 7, "expired")]
    assert started[-1].lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def frames_of(spark, triggers, schema):
    return [spark.createDataFrame(t, schema) for t in triggers]


def test_stale_rows_are_judged_one_by_one_and_counted(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    triggers = [[(1, at(10)), (2, at(4)), (3, None)], [(4, at(5)), (5, at(4))], [(6, at(30)), (7, at(11)), (8, at(24))]]
    keep = S.StaleRows(spark, "ts", "6 HOURS")
    S.replay(frames_of(spark, triggers, "id long, ts timestamp"), "test", partial(S.into_batches, take=keep))
    assert sorted(r.id for r in keep.rows().collect()) == [1, 2, 4, 5, 6, 8]
    assert tuple(keep.counts.now().first()) == (at(30), 8, 2)


def test_a_repeated_trigger_changes_nothing(spark):
    batch = spark.createDataFrame([(1, START), (2, START - dt.timedelta(hours=9))], "id long, ts timestamp")
    keep = S.StaleRows(spark, "ts", "6 HOURS")
    for _ in range(3):
        keep(batch, 0)
    assert tuple(keep.counts.now().first())[1:] == (2, 1) and keep.rows().count() == 1
    days = S.LateDays(spark, "day")
    for _ in range(2):
        days(batch.select(F.to_date("ts").alias("day")), 0)
    assert sorted((r.rows, r.reads) for r in days.state.now().collect()) == [(1, 1), (1, 1)]


def test_late_rows_open_a_final_day_again(spark):
    d = lambda n: (START + dt.timedelta(days=n)).date()
    triggers = [[(d(0),), (d(0),), (d(1),)], [(d(2),), (None,)], [(d(0),), (d(1),), (d(3),)], []]
    days = S.LateDays(spark, "day")
    S.replay(frames_of(spark, triggers, "day date"), "test", partial(S.into_batches, take=days))
    got = {r.day: tuple(r)[1:] for r in days.state.now().collect()}
    # rows, late rows, reopened, reads, final: day 0 was final after the second trigger and came again in the third.
    assert got == {d(0): (3, 1, 1, 3, True), d(1): (2, 0, 0, 3, True), d(2): (1, 0, 0, 3, False), d(3): (1, 0, 0, 2, False)}  # the empty trigger counts too
