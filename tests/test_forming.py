"""Form and workload groups: strictly as of the day, and by hand on a small log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorframe.plans import form as P
from priorframe.queries import forming as Q

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def test_later_days_change_no_row(spark, tmp_path):
    edge = F.lit("2024-01-15").cast("date")
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = F.to_date("ts") >= edge
    events.withColumn("event_type", F.when(late, F.lit("purchase")).otherwise(F.col("event_type"))).withColumn("value", F.when(late, 100 - F.col("value")).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    for build in (Q.form_asof, Q.mix_asof, Q.workload_asof, Q.load_distribution):
        rows = lambda sf: sorted(map(str, build(spark, sf).filter(F.col("day") <= edge).collect()))  # noqa: B023, E731
        a, b = rows(SF), rows(str(tmp_path))
        assert len(a) > 50 and a == b


def test_form_by_hand(spark):
    flags = {n: F.col(n) for n in Q.SAYS}
    row = lambda d, kind, hit, swing, whiff, level: (1, DAY + dt.timedelta(days=d), kind, True, hit, swing, whiff, False, swing, whiff, hit, hit, True, True, level)
    rows = [row(0, "a", True, True, True, 10.0), row(0, "a", False, True, False, None), row(0, "b", False, False, False, 30.0), row(2, "b", True, True, False, 50.0), row(5, "a", True, True, True, None)]
    log = spark.createDataFrame(rows, f"entity int, day date, kind string, {', '.join(f'{n} boolean' for n in Q.SAYS)}, level double")
    days = P.form_days(log, "entity", "day", "kind", ("a", "b", "c"), flags, F.col("level"))
    got = {(r.day - DAY).days: r for r in P.form_state(days, "entity", "day", ("a", "b", "c"), ("a",), F.lit("2000-01-01").cast("date"), 2, 2).collect()}
    assert (got[0].rate, got[0].rate_shrunk, got[0].mix, got[0].total_rows, got[0].n_found, got[0].zone_share) == (None, None, {}, 0, 0, None)
    x = got[5]
    assert (x.total_rows, x.total_units, x.n_found, x.rate, x.whiff_share, x.zone_share) == (4, 4, 2, 0.5, 0.25, 1.0)
    assert x.rate_shrunk == pytest.approx((2 + 70 * 0.225) / 74) and x.rolling_3 == 0.5 and x.trend is None
    assert x.level_delta == 50.0 - 20.0  # the last day with a level against all before its two days
    assert {k: (v.usage, v.whiff_rate, v.n) for k, v in x.mix.items()} == {"a": (0.5, 0.5, 2), "b": (0.5, 0.0, 2)}
    assert (x.breadth, x.fast_share, x.mix_whiff) == (2, 0.5, 0.25) and got[2].rolling_5 == pytest.approx(1 / 3)


def test_workload_by_hand(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    days = spark.createDataFrame([(1, 1, d(0), 30, 10), (1, 1, d(1), 5, 2), (1, 1, d(2), 40, 12), (1, 1, d(30), 9, 9), (2, 1, d(1), 7, 3)], "entity int, side int, day date, rows long, done long")
    mix = days.select("entity", "day", F.lit(0.7).alias("fast_share"), F.lit(2).alias("breadth"))
    limits = spark.createDataFrame([(1, d(30), 85)], "entity int, day date, announced_limit int")
    got = {(r.entity, (r.day - DAY).days): r for r in P.workload_state(days, "entity", "side", "day", mix, limits).collect()}
    assert (got[(1, 0)].load_mean, got[(1, 0)].load_std, got[(1, 0)].load_n, got[(1, 0)].leash_mean, got[(1, 0)].leash_std) == (None, None, 0, 88.0, 14.0)
    x = got[(1, 30)]
    assert (x.load_mean, x.load_n, x.load_dist) == (11.0, 2, {10: 0.5, 12: 0.5}) and x.load_std == pytest.approx(2**0.5)
    assert (x.leash_mean, x.back_from_absence, x.announced_limit, x.fast_heavy, x.fade) == (35.0, True, 85, True, -0.04) and x.leash_std == pytest.approx(50**0.5)
    assert (got[(1, 2)].others_2d, got[(1, 2)].others_3d, got[(1, 2)].load_std, got[(1, 2)].announced_limit) == (12, 12, 0.0, None)
