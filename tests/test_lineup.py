"""Lineups, habits, screens and deep dives on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from priorframe.plans import evaluate as E, fit, lineup as L


def test_lineup_with_unknown_rates(spark):
    rows = [(1, 1, 0.3, 0.2, 0.25, None, "L", 5), (1, 2, None, 0.2, None, 0.8, "R", 500), (2, 9, None, None, None, None, "R", 99)]
    slots = spark.createDataFrame(rows, "game int, pos int, rate double, own_rate double, chase double, contact double, stands string, trials int")
    got = {x["game"]: x for x in L.lineup_aggregates(slots, ["game"]).collect()}
    assert math.isclose(got[1]["weighted_rate"], (4.65 * 0.3 + 4.53 * 0.225) / (4.65 + 4.53))
    assert (got[1]["chase"], got[1]["contact"], got[1]["n_left"], got[1]["n_bench"], got[1]["n_rookies"]) == (0.25, 0.8, 1, 1, 1)
    # League against league is the league's rate.
    assert math.isclose(got[2]["matchup"], 0.225) and got[2]["chase"] is None and got[2]["n_rookies"] == 1
    assert L.lineup_aggregates(slots.limit(0), ["game"]).count() == 0


def test_sides_and_platoon(spark):
    df = spark.createDataFrame([("S", "L", 0.3), ("S", "R", None), ("L", "R", 0.1)], "bats string, hand string, rate double")
    got = [tuple(x) for x in df.select(L.effective_side("bats", "hand"), L.platoon_regressed("rate", F.lit(570), "hand")).collect()]
    assert [x[0] for x in got] == ["R", "L", "L"]
    assert math.isclose(got[0][1], (0.3 + 0.225) / 2) and got[1][1] == 0.225


def test_first_slots_keep_nine_in_order(spark):
    log = spark.createDataFrame([(1, m, t) for t, m in enumerate([*range(12), 0, 1])], "game int, member int, t int")
    got = {x["member"]: x["pos"] for x in L.first_slots(log, ["game"], "member", "t").collect()}
    assert got == {m: m + 1 for m in range(9)}


def test_over_league_is_strictly_before(spark):
    days = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 10, 1), (1, 2, 10, 10)], "id int, day int, t int, h int")
    got = {(x["id"], x["day"]): x["d"] for x in L.over_league(days, "id", "day", "t", "h", 10, "d").collect()}
    assert got[(1, 1)] is None and math.isclose(got[(1, 2)], 0.5 - 0.3)


@pytest.fixture(scope="module")
def world(spark):
    rows = [(i, i % 4, float(i * 37 % 101), 1 if i * 37 % 101 > 50 else 0, 0.4, 0.3 + 0.4 * (i * 37 % 101 > 50)) for i in range(800)]
    return spark.createDataFrame(rows, "id int, epoch int, x double, y int, b double, p double").withColumn("junk", F.col("id") * 7919 % 97 * 1.0).cache()


def test_ranked_screen(world):
    e = F.col("epoch")
    out = E.ranked_screen(world, [], {"x": 1, "junk": 1, "b": 0}, "y", [(e <= s, e == s + 1) for s in (0, 1, 2)], 0.01)
    assert out[0]["candidate"] == "x" and out[0]["survives"] and out[0]["worst"] == min(out[0]["gains"])
    assert not any(x["survives"] for x in out[1:])
    assert not E.ranked_screen(world, [], {"x": -1}, "y", [(e <= 0, e == 1)])[0]["survives"]


def test_effects_are_scored(world):
    f = fit.logistic(world, ["junk", "x"], "y", penalty={"x": 1.0})
    got = {x["term"]: x for x in E.effect_directions(world, f, {"x": 1, "nothing": 1})}
    rows = world.toPandas()
    c = dict(zip(f.names, f.coef))
    s = lambda z: 1 / (1 + (-z.clip(-20, 20)).map(math.exp))
    z = c["1"] + c["x"] * rows.x + c["junk"] * rows.junk
    assert math.isclose(got["x"]["shift"], (s(z + c["x"] * rows.x.std()) - s(z)).mean(), rel_tol=1e-6) and got["x"]["verdict"] == "ok"
    assert got["nothing"]["verdict"] == "untested"


def test_blend_weight_is_least(world):
    got = E.blend_weight(world, "p", "b", "y").collect()
    rows = world.toPandas()
    for x in got:
        assert math.isclose(x["brier"], ((rows.b + x["w"] * (rows.p - rows.b) - rows.y) ** 2).mean(), rel_tol=1e-9)
    assert math.isclose(got[0]["best"], ((rows.p - rows.b) * (rows.y - rows.b)).mean() / ((rows.p - rows.b) ** 2).mean())


def test_leaks_are_counted(spark):
    days = spark.createDataFrame([(1, "2024-01-01", 2), (1, "2024-01-03", 1), (2, "2024-01-01", 0)], "e int, d string, n int").withColumn("d", F.to_date("d"))
    assert tuple(E.leak_recount(days, "e", "d", "n").first()) == (3, 0, 2)


def test_noise_does_not_pass(world):
    e = F.col("epoch")
    assert E.noise_floor(world, ["x"], "id", "y", [e <= s for s in (0, 1)], 5) < 0.05


def test_backtest_by_line_adds_up(world):
    e = F.col("epoch")
    rows = world.withColumn("line", F.col("id") % 3)
    got = E.backtest(rows, {"a": (e <= 1, e == 2)}, ["junk"], "y", "b", "line").collect()
    whole = E.backtest(rows, {"a": (e <= 1, e == 2)}, ["junk"], "y", "b").first()
    lines = [x for x in got if x["line"] != "all"]
    assert {x["line"] for x in got} == {"0", "1", "2", "all"} and sum(x["n"] for x in lines) == whole["n"]
    for c in ("model", "naive"):
        assert math.isclose(sum(x[c] * x["n"] for x in lines) / whole["n"], whole[c], rel_tol=1e-9)
        assert math.isclose(next(x[c] for x in got if x["line"] == "all"), whole[c], rel_tol=1e-9)


def test_paired_by_group(spark):
    df = spark.createDataFrame([("u", 0.5, 0.4, 1), ("u", 0.9, 0.2, 1), ("v", 0.3, 0.3, 0)], "g string, a double, b double, y int")
    got = {x["g"]: x for x in E.paired_by_group(df, ["g"], "a", "b", "y").collect()}
    assert math.isclose(got["u"]["gain"], ((0.36 - 0.25) + (0.64 - 0.01)) / 2) and got["u"]["z"] > 0 and (got["v"]["gain"], got["v"]["z"]) == (0.0, 0.0)
