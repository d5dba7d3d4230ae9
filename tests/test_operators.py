import numpy as np
import pytest
from pyspark.sql import functions as F

from priorframe.operators import joins, ledger, market, quality, ranking
from priorframe.plans import evaluate, fit
from priorframe.sources import files


def test_upsert_is_idempotent_and_never_shrinks(spark):
    schema = "k int, graded string, updated int, note string"
    old = spark.createDataFrame([(1, "WIN", 1, "a"), (2, None, 5, "b"), (3, None, 1, None)], schema)
    new = spark.createDataFrame([(1, None, 9, "x"), (2, "LOSS", 1, None), (3, None, 1, "full"), (4, None, 1, "n")], schema)
    once = ledger.ledger_upsert(old, new, ["k"], "graded", "updated")
    assert sorted(map(tuple, once.collect())) == [(1, "WIN", 1, "a"), (2, "LOSS", 1, None), (3, None, 1, "full"), (4, None, 1, "n")]
    assert sorted(map(tuple, ledger.ledger_upsert(once, new, ["k"], "graded", "updated").collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(ValueError, match="shrink"):
        ledger.refuse_to_shrink(once, old)


def test_ladder_of_crossed_odds_never_rises(spark):
    rungs = spark.createDataFrame([(1, 4, -300), (1, 5, 200), (1, 6, -400)], "e int, m int, odds int")
    rows = market.devig_ladder(rungs, spark.createDataFrame([(1, 0.05)], "e int, hold double"), "e", "m", "odds").orderBy("m").collect()
    assert [r.fair for r in rows] == sorted((r.fair for r in rows), reverse=True)


def test_ladder_stakes_descend_under_the_cap(spark):
    rows = [(1, m, 150, p, 5.5, "OVER", 2.0, 8.0) for m, p in ((6, 0.8), (7, 0.75), (8, 0.7), (9, 0.6))]
    df = spark.createDataFrame(rows, "e int, milestone int, odds int, model double, line double, side string, units double, expected double")
    got = {r.milestone: r for r in market.evaluate_ladder(df, "e", {c: c for c in ("line", "side", "units", "expected", "milestone", "odds", "model")}).collect()}
    assert got[6].status == "primary_equivalent" and got[9].status == "passed_not_next_rung"
    assert (got[7].status, got[7].units) == ("bet", 1.0) and (got[8].status, got[8].units) == ("bet", 0.5)
    shut = df.withColumn("expected", F.lit(6.0))
    assert {r.status for r in market.evaluate_ladder(shut, "e", {c: c for c in ("line", "side", "units", "expected", "milestone", "odds", "model")}).collect()} == {"primary_equivalent", "passed_gap_gate"}


def test_portfolio_cap(spark):
    rows = [("d", i, i % 2, 2.0, 0.2 - i / 100) for i in range(8)]
    got = {r.bet: r.units for r in market.portfolio_cap(spark.createDataFrame(rows, "day string, bet int, game int, stake double, edge double"), "day", "bet", "game", "stake", "edge").collect()}
    assert got[0] == got[1] == 2.0 and got[2] == 1.5 and sum(got.values()) <= 10


def test_portfolio_cap_of_many_bets_matches_a_loop(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(d, i, rng.choice([None, *range(6 * d)]), rng.choice([0.0, 0.1, 0.25, 0.27, 0.3, 0.5, 2.0][: 5 + d % 3]), rng.choice([0.01, 0.02, 0.1])) for d in (1, 2, 40) for i in range(1200)]
    df = spark.createDataFrame(rows, "day int, bet int, game int, stake double, edge double")
    want = {}
    for d in (1, 2, 40):
        left, seen = 10.0, set()
        for _, bet, game, stake, _ in sorted((r for r in rows if r[0] == d and r[3] > 0), key=lambda r: (-r[4], r[1])):
            asked = stake * 0.85 if game in seen else stake
            given = max((x for x in market.prices.DENOMINATIONS if min(asked, left) >= x - 1e-9), default=0.0) if left > 0 else 0.0
            left -= given
            seen |= {game} if given > 0 and game is not None else set()
            want[d, bet] = (given, given <= 0)
    # No list holds more than a day's leading bets.
    order = F.sort_array
    monkeypatch.setattr(market.F, "sort_array", lambda x: F.when(F.size(x) > 100, F.raise_error(F.lit("a whole day in one list"))).otherwise(order(x)))
    for parts in (2, 256):
        monkeypatch.setattr(market, "DAY_PARTS", parts, raising=False)
        capped = market.portfolio_cap(df, "day", "bet", "game", "stake", "edge")
        assert {(r.day, r.bet): (r.units, r.capped) for r in capped.collect()} == want


def test_no_slate_document_holds_a_whole_day(spark):
    from priorframe.sources import files

    rows = spark.range(2000).selectExpr("'d' AS day", "id AS entity", "1.5 AS line", "1 AS milestone", "100 AS odds")
    docs = files.nest_slate(rows, "day", "entity", ["line"], ["milestone", "odds"]).collect()
    assert len(docs) > 1 and sum(r.document.count('"entity"') for r in docs) == 2000


def test_all_entities_are_flattened(spark):
    from priorframe.queries import load

    sf = "/root/testdata/sf0.001"
    got = {r.pitcher_id for r in load()[0]["flatten_slate_all"](spark, sf).select("pitcher_id").distinct().collect()}
    assert got == {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}


@pytest.mark.parametrize("rule", ["round", "floor", "chunk"])
def test_equal_count_bins(spark, rule):
    n, bins = 103, 10
    df = spark.createDataFrame([(i, float((i * 37) % 50)) for i in range(n)], "id int, v double")
    got = {r.id: r.bin for r in ranking.equal_count_bins(df, "v", ["id"], bins, rule).collect()}
    for k, i in enumerate(sorted(range(n), key=lambda i: ((i * 37) % 50, i))):
        want = k // (n // bins) if rule == "chunk" else sum(k >= (round(b * n / bins) if rule == "round" else b * n // bins) for b in range(1, bins))
        assert got[i] == want


def test_ambiguous_names_are_refused(spark):
    roster = spark.createDataFrame([(1, "Luis García", "WSN"), (2, "Luis Garcia", "HOU"), (3, "Ann Bo", "AA")], "id int, name string, team string")
    props = spark.createDataFrame([(1, "Luis Garcia"), (2, "Luis Garcia (HOU)"), (3, "X Bo"), (4, "Nobody")], "p int, prop string")
    got = {r.p: (r.entity, r.reason) for r in joins.match_names(props, roster, "prop", "p", "name", "id", "team").collect()}
    assert got == {1: (None, "ambiguous"), 2: (2, "full_name"), 3: (3, "last_name"), 4: (None, "no_match")}


def test_a_common_name_is_counted_not_expanded(spark):
    """20,000 props and 20,000 entities of one name: 400,000,000 pairs, of which none are made; keys that repeat, and teams and tags that are null, count as before."""
    roster = spark.range(20000).select("id", F.lit("Ann Lee").alias("name"), F.when(F.col("id") == 7, "AA").otherwise("BB").alias("team"))
    roster = roster.unionByName(spark.createDataFrame([(30000, "Cy Roe", None), (30001, "Di Roe", "CC"), (None, "Ed Fox", "DD"), (30002, "Ed Fox", "EE")], "id long, name string, team string"))
    props = spark.range(20000).select(F.col("id").alias("p"), F.when(F.col("id") == 0, "Ann Lee (AA)").when(F.col("id") == 1, "Bo Lee (AA)").otherwise("Ann Lee").alias("prop"))
    odd = [(20000, "Cy Roe"), (20001, "X Roe"), (20002, "X Roe (CC)"), (20003, "Ed Fox"), (20004, "Ed Fox (DD)"), (20005, None), (20006, "Cy Roe"), (20006, "Ed Fox (EE)"), (None, "Cy Roe")]
    props = props.unionByName(spark.createDataFrame(odd, "p long, prop string"))
    found = joins.match_names(props, roster, "prop", "p", "name", "id", "team")
    got = {(r.p, r.entity, r.reason): r["count"] for r in found.filter("p IS NULL OR p < 2 OR p >= 20000").groupBy("p", "entity", "reason").count().collect()}
    assert got == {
        (0, 7, "full_name"): 1, (1, 7, "last_name"): 1, (20000, 30000, "full_name"): 1, (20001, None, "ambiguous"): 1, (20002, 30001, "last_name"): 1, (20003, 30002, "full_name"): 1,
        (20004, None, "ambiguous"): 1, (20005, None, "no_match"): 1, (20006, 30002, "full_name"): 2, (None, None, "no_match"): 1,
    }
    assert found.filter("p BETWEEN 2 AND 19999 AND reason = 'ambiguous'").count() == 19998


def test_missing_columns_and_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="c, d"):
        files.normalize_columns(df, {"a": (), "c": ("x",), "d": ()})
    with pytest.raises(ValueError, match="share values of a"):
        joins.require_no_overlap(df, df, ["a"])


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "id int, odds int")
    files.append_capture(rows, "2024-01-01 10:00:00", f"{tmp_path}/log")
    files.append_capture(rows, "2024-01-01 11:00:00", f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").select("captured_at").distinct().count() == 2
    files.sink_partitions(rows, f"{tmp_path}/table", ["id"])
    files.sink_partitions(rows.filter("id = 1").withColumn("odds", F.lit(99)), f"{tmp_path}/table", ["id"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").select("id", "odds").collect())) == [(1, 99), (2, 20)]
    rows.write.option("header", True).csv(f"{tmp_path}/closing_2024-08-06.csv")
    back = files.scan_csv_captures(spark, f"{tmp_path}/closing_*.csv/*.csv", rows.schema)
    assert back.count() == 2


def test_fits_recover_known_models(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=4000), rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    c = rng.negative_binomial(4, 4 / (4 + np.exp(1 + 0.5 * x)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y, c, 2 * x - z + rng.normal(size=4000))], "x double, z double, y double, c double, w double")
    f = fit.logistic(df, ["x", "z"], "y")
    assert np.allclose(f.coef, [0.5, 1.2, 0], atol=0.15) and abs(f.t[2]) < 3
    assert abs(fit.logistic(df, ["x"], "y", penalty={"x": 1e6}).coef[1]) < 0.01
    assert np.allclose(fit.ols(df, ["x", "z"], "w").coef, [0, 2, -1], atol=0.08)
    g, log_alpha = fit.negative_binomial(df, ["x"], "c")
    assert np.allclose(g.coef, [1, 0.5], atol=0.1) and abs(np.exp(log_alpha) - 0.25) < 0.08


def test_screen_finds_the_signal_and_not_the_noise(spark):
    rng = np.random.default_rng(1)
    x, z, e = rng.normal(size=(3, 3000))
    df = spark.createDataFrame([(float(a), float(b), float(a + c), i) for i, (a, b, c) in enumerate(zip(x, z, e))], "x double, z double, y double, i int").withColumn("one", F.rand(1))
    got = {r["candidate"]: r for r in evaluate.factor_screen(df, ["one"], ["x", "z"], "y", F.col("i") % 2 == 0)}
    assert got["x"]["t"] > 5 and abs(got["z"]["t"]) < 4


def test_isotonic_is_monotone(spark):
    df = spark.createDataFrame([(i, i / 400, float((i * 7919) % 400 < i)) for i in range(400)], "i int, p double, y double")
    knots = fit.isotonic_fit(df, "p", "y", ["i"], 20)
    assert [y for _, y in knots] == sorted(y for _, y in knots)
    assert fit.isotonic_fit(df.limit(5), "p", "y", ["i"]) == [(0.0, 0.0), (1.0, 1.0)]


def test_clusters_widen_the_error(spark):
    df = spark.createDataFrame([(g, 0.5, 0.4 + 0.01 * g, g % 2) for g in range(20) for _ in range(10)], "g int, a double, b double, y int")
    rows, clusters = evaluate.paired_test(df, "a", "b", "y").first(), evaluate.paired_test(df, "a", "b", "y", ["g"]).first()
    assert clusters.se > 2.5 * rows.se and clusters.n == 20
    assert evaluate.paired_test(df, "a", "a", "y").first().z == 0


def test_reports(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "k int, d double")
    bad = quality.report(df, "drift", F.col("d") > 0.5, "k").first()
    assert (bad.status, bad.n, bad.sample) == ("fail", 1, ["2"])
    assert quality.monotonic(df, 3).first().status == "fail"


def test_ranks_of_tied_and_missing_values(spark):
    """Half of all rows have one value: their ranges are cut by the tie, so no task has most of them."""
    n = 4000
    df = spark.createDataFrame([(i * 7919 % n, None if i % 10 == 0 else 1.0 if i % 2 else float(i % 50)) for i in range(n)], "id int, v double").repartition(5)
    rows, count = ranking.ranked(df, "v", ["id"])
    got = {r.id: r["rank"] for r in rows.collect()}
    values = {r.id: r.v for r in df.collect()}
    order = sorted(values, key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert count == n and [got[i] for i in order] == list(range(n))
    sizes = [r["count"] for r in df.repartitionByRange(16, "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * n / 16


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.integers(0, 20, 501)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(9999, None)], "id int, v double")
    q = [0.0, 0.1, 0.333, 0.5, 0.999, 1.0]
    assert np.allclose(ranking.exact_quantiles(df, "v", ["id"], q), np.quantile(v, q))
    assert ranking.exact_quantiles(df.limit(0), "v", ["id"], q) == []


def test_unclean_splits_are_refused(spark):
    schema = "epoch int, game int, entity int, day string"
    train = spark.createDataFrame([(2024, 1, 1, "2024-05-01"), (2023, 2, 1, "2023-05-01")], schema)
    test = spark.createDataFrame([(2025, 9, 1, "2025-05-01")], schema)
    joins.require_clean_split(train, test, "epoch", ["game", "entity"], "day", 2023)
    with pytest.raises(ValueError, match="1 early_epochs"):
        joins.require_clean_split(train, test, "epoch", ["game", "entity"], "day", 2024)
    with pytest.raises(ValueError, match="1 days, 1 epochs, 1 keys"):
        joins.require_clean_split(train, train.limit(1), "epoch", ["game", "entity"], "day", 2023)
