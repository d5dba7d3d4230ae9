"""The daily board: every quote is told of, gates in order, stakes under the caps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from priorframe.operators import market
from priorframe.plans import board as B
from priorframe.queries import boards as Q

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 5, 1)


def test_gates_in_order_and_scores(spark):
    quotes = spark.createDataFrame([(DAY, i, i, dt.datetime(2024, 5, 1, h), dt.datetime(2024, 5, 1, 18), 1.5) for i, h in enumerate([2, 17, 17, 17, 17, 17])], "day date, entity long, quote long, ts timestamp, start timestamp, line double")
    schedule = spark.createDataFrame([(DAY, i, True, i != 2) for i in (0, 2, 3, 4, 5)], "day date, entity long, confirmed boolean, regular boolean")
    state = spark.createDataFrame([(DAY, i, g, m, 40, 10) for i, g, m in [(0, 9, 4.0), (2, 9, 4.0), (4, 9, 1.0), (5, 9, 4.0)]], "day date, entity long, games long, mean double, trials long, hits long")
    rows = {r.entity: r for r in B.scored(B.gated(B.latest_quotes(quotes, "ts", "start", 12.0), schedule, state, 3, 1.5), "line", F.lit(0.2), 20.0).collect()}
    assert [rows[i].reason for i in range(6)] == ["stale_quote", "not_scheduled", "not_regular", "few_appearances", "short_outings", None]
    mean = 4.0 * (10 + 4) / 60
    size = 1 / B.DISPERSION
    p = [math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1)) * (size / (size + mean)) ** size * (mean / (size + mean)) ** k for k in range(2)]
    assert rows[5].expected == pytest.approx(mean) and rows[5].p_over == pytest.approx(1 - sum(p))


def test_the_last_quote_before_the_start_counts(spark):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    quotes = spark.createDataFrame([(DAY, 1, q, at(h), at(18)) for q, h in [(1, 9), (2, 15), (3, 19)]], "day date, entity long, quote long, ts timestamp, start timestamp")
    assert [(r.quote, r.stale) for r in B.latest_quotes(quotes, "ts", "start", 12.0).collect()] == [(2, False)]


def test_ledger_rows_of_the_whole_board(spark):
    scores = {(r.day, r.entity): r for r in Q.board_scores(spark, SF).collect()}
    rows = Q.board_ledger(spark, SF).collect()
    primary = {(r.day, r.entity): r for r in rows if r.kind == "primary"}
    assert primary.keys() == scores.keys() and len(rows) > len(primary)
    for key, r in primary.items():
        reason = scores[key].reason
        assert r.status == reason and r.units == 0 if reason else r.status in ("bet", "no_play")
        assert r.units <= r.stake and (r.status == "bet" or r.units == 0)
    for day in {r.day for r in rows}:
        assert sum(r.units for r in rows if r.day == day) <= market.DAILY_CAP + 1e-9
    ladder = [r for r in rows if r.kind == "ladder"]
    assert ladder and all(scores[(r.day, r.entity)].reason is None for r in ladder)
    bets = [r for r in ladder if r.status == "bet"]
    assert all(r.units <= r.stake for r in bets) and any(r.status == "passed_gap_gate" for r in ladder)
    assert any(r.capped for r in rows if r.status == "bet") or all(r.units == r.stake for r in rows if r.status == "bet")
