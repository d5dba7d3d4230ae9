import itertools
import math

import pytest
from pyspark.sql import functions as F

from priorframe.functions import names, pmf, prices, rates, special


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_poisson_binomial_and_compound(spark):
    probs = [0.2, 0.5, 0.7]
    column = F.array(*(F.lit(p) for p in probs))
    want = [0.0] * 4
    for bits in itertools.product((0, 1), repeat=3):
        want[sum(bits)] += math.prod(p if b else 1 - p for p, b in zip(probs, bits))
    assert value(spark, pmf.poisson_binomial(column)) == pytest.approx(want, abs=1e-12)
    trials = [0.1, 0.2, 0.3, 0.4]
    mixed = [0.0] * 4
    for n, w in enumerate(trials):
        for k, p in enumerate(value(spark, pmf.poisson_binomial(F.slice(column, 1, n)) if n else F.array(F.lit(1.0)))):
            mixed[k] += w * p
    assert value(spark, pmf.compound(column, F.array(*(F.lit(t) for t in trials)))) == pytest.approx(mixed, abs=1e-12)


def test_negative_binomial_and_mixture(spark):
    mu, alpha = 4.0, 0.25
    r = 1 / alpha
    want = [math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mu)) + k * math.log(mu / (r + mu))) for k in range(20)]
    assert value(spark, pmf.negbin_pmf(F.lit(mu), F.lit(alpha), 19)) == pytest.approx(want, abs=1e-12)
    mixed = value(spark, pmf.hook_mixture_pmf(F.lit(20.0), F.lit(0.02)))
    assert sum(mixed) == pytest.approx(1, abs=1e-9) and sum(k * p for k, p in enumerate(mixed)) == pytest.approx(20, abs=0.1)


def test_binomial_mixture_and_survival_are_distributions(spark):
    mixed = value(spark, pmf.binomial_mixture(F.lit(9.0), F.lit(2.0), F.lit(0.3), 20))
    assert sum(mixed) == pytest.approx(1, abs=1e-6) and sum(k * p for k, p in enumerate(mixed)) == pytest.approx(2.7, abs=0.01)
    outs = value(spark, pmf.survival_pmf(F.array_repeat(F.lit(0.8), 9), F.array_repeat(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), 9)))
    assert len(outs) == 28 and sum(outs) == pytest.approx(1, abs=1e-9) and outs[27] == pytest.approx(0.8**9)


def test_tails(spark):
    p = F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 0.0, 0.4, 0.6)))
    assert value(spark, pmf.tail_above(p, F.lit(5.5))) == pytest.approx(0.6)
    assert value(spark, pmf.tail_above(p, F.lit(4.5))) == pytest.approx(1.0)
    assert value(spark, pmf.tail_at_least(p, F.lit(6))) == pytest.approx(0.6)
    with pytest.raises(Exception, match="fraction"):
        value(spark, pmf.tail_above(p, F.lit(5.0), refuse_whole=True))


def test_prices(spark):
    assert value(spark, prices.parse_american(F.lit("−120"))) == -120
    assert value(spark, prices.decimal_odds(F.lit(0))) is None
    assert value(spark, prices.implied(F.lit(-300))) == pytest.approx(0.75)
    assert [value(spark, prices.quantize(F.lit(x))) for x in (0.1, 0.2, 0.5, 0.8, 1.5, 2.5, 9.0)] == [0.0, 0.25, 0.5, 1.0, 2.0, 2.0, 2.0]
    assert [value(spark, prices.quantize_down(F.lit(x))) for x in (0.2, 0.3, 0.99, 1.7, 5.0)] == [0.0, 0.25, 0.5, 1.5, 2.0]
    assert value(spark, prices.profit(F.lit("WIN"), F.lit(2.0), F.lit(0))) is None
    line = value(spark, prices.parse_line(F.lit("6+")))
    assert line.value == 6 and line.is_milestone
    assert value(spark, prices.innings_to_outs(F.lit("6.2"))) == 20


def test_rates(spark):
    assert value(spark, rates.matchup_rate(0.225, 0.225)) == pytest.approx(0.225, abs=1e-9)
    assert value(spark, rates.shrink_rate(F.lit(0), F.lit(0), 0.3, 50)) == pytest.approx(0.3)
    assert value(spark, special.normal_cdf(F.lit(1.96))) == pytest.approx(0.9750021, abs=1e-6)
    assert value(spark, special.normal_cdf(F.lit(-1.0))) == pytest.approx(0.1586553, abs=1e-6)


def test_names(spark):
    for text, want in (("José  Ramírez Jr. (CLE)", "jose ramirez"), ("Michael Harris II", "michael harris"), ("  A   B ", "a b"), (None, None)):
        assert value(spark, names.normalize_name(F.lit(text).cast("string"))) == want
    assert value(spark, names.team_tag(F.lit("Ryan Johnson (LAA)"))) == "LAA"
    assert value(spark, names.team_tag(F.lit("Ryan Johnson (prospect)"))) is None
    assert [value(spark, names.role_bucket(F.lit(d).cast("int"))) for d in (None, 2, 5, 7, 9, 20, 21)] == ["unknown", "<=2", "5", "7", "8-10", "11-20", "21+"]
    assert value(spark, names.zone_distance(F.lit(0.5), F.lit(float("nan")), F.lit(3.5), F.lit(1.5), 0.83)) == pytest.approx(-0.33)


def test_marks_come_off_all_letters(spark):
    """Against canonical decomposition, over every letter, and with combining marks that stand alone."""
    import sys
    import unicodedata

    from priorframe.functions import names

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" and not 0xAC00 <= c <= 0xD7A3]
    texts = ["".join(letters[i : i + 200]) for i in range(0, len(letters), 200)] + ["éö", "Džǎiro", "Đuro Łuk", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", names.without_marks("t").alias("t")).collect()
    for r in got:
        assert r.t == (None if texts[r.i] is None else plain(texts[r.i]))
    named = spark.createDataFrame([("  Nguyễn Văn  Ánh (LAA) Jr.",), ("ŽELJKO ĐORĐEVIĆ III",)], "n string").select(names.normalize_name("n").alias("n")).collect()
    assert [r.n for r in named] == ["nguyen van anh", "zeljko đorđevic"]


def test_ladder_has_no_last_rung(spark):
    """Rungs far above the usual ones are told of too, and stakes go in order to candidates alone."""
    from priorframe.operators import market

    rows = [(1, 40.5, "OVER", 1.0, 44.0, m, 300, 0.6) for m in (5, 41, 42, 43, 44, 90)]
    df = spark.createDataFrame(rows, "e int, line double, side string, units double, expected double, milestone int, odds int, model double")
    got = {r.milestone: (r.status, r.units) for r in market.evaluate_ladder(df, "e", {k: k for k in ("line", "side", "units", "expected", "milestone", "odds", "model")}).collect()}
    assert set(got) == {5, 41, 42, 43, 44, 90} and got[41][0] == "primary_equivalent" and got[90] == ("passed_not_next_rung", 0.0)
    assert got[42][0] == got[43][0] == "bet" and 0 < got[43][1] < got[42][1] <= 0.5
