"""Gates, dives, mixtures and the composed screen table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorframe.plans import dives as D, fit, gates as G, mixture as X, screen_table as T
from priorframe.queries import screening as Q

SF = "/root/testdata/sf0.001"


# --- mixture -----------------------------------------------------------------------------------------


def draws(n=40_000, share=0.08, short=6.0, short_dispersion=0.15, dispersion=0.02, seed=0):
    rng = np.random.default_rng(seed)
    mean = rng.uniform(20, 26, n)
    own = rng.random(n) < share
    m = np.where(own, short, (mean - share * short) / (1 - share))
    r = 1 / np.where(own, short_dispersion, dispersion)
    return rng.poisson(rng.gamma(r, m / r)), mean


def test_planted_mixture_is_found_and_the_likelihood_never_falls(spark):
    y, m = draws()
    t = X.cells(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, m)], "y int, m double"), "y", "m")
    assert t[:, 2].sum() == len(y) and len(t) < 2000
    found = X.mixture_fit(t, [(0.02, 5.0), (0.1, 12.0)], rounds=80, least_gain=1e-4)
    assert found.share == pytest.approx(0.08, abs=0.01) and found.short == pytest.approx(6.0, abs=0.4)
    assert found.short_dispersion == pytest.approx(0.15, abs=0.06) and found.dispersion == pytest.approx(0.02, abs=0.004)
    assert all(b >= a - 1e-9 for a, b in zip(found.path, found.path[1:]))
    alone, loglik = X.fit_one(t)
    assert found.loglik > loglik + 100
    marks = (5, 8, 12)
    assert X.tail_error(t, found.log_pmf, marks) < 0.3 * X.tail_error(t, lambda k, mean: X.log_pmf(k, mean, alone), marks)


def test_log_pmf_sums_to_one_and_equals_the_plain_formula():
    k = np.arange(400.0)
    for mean, a in ((3.0, 0.5), (20.0, 0.02)):
        p = np.exp(X.log_pmf(k, np.full(400, mean), a))
        assert p.sum() == pytest.approx(1, abs=1e-9) and (p @ k) == pytest.approx(mean, rel=1e-6)
        r = 1 / a
        plain = math.lgamma(7 + r) - math.lgamma(8) - math.lgamma(r) + r * math.log(r / (r + mean)) + 7 * math.log(mean / (r + mean))
        assert X.log_pmf(np.array([7.0]), np.array([mean]), a)[0] == pytest.approx(plain, abs=1e-10)
    mixed = X.Mixture(0.1, 5.0, 0.1, 0.05)
    p = np.exp(mixed.log_pmf(k, np.full(400, 22.0)))
    assert p.sum() == pytest.approx(1, abs=1e-9) and (p @ k) == pytest.approx(22, rel=1e-6)


# --- gates -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x, epoch, base = rng.normal(size=n), rng.integers(1, 5, n), rng.uniform(0.2, 0.8, n)
    p = 1 / (1 + np.exp(-(np.log(base / (1 - base)) + 0.8 * x)))
    rows = [(i, int(epoch[i]), float(x[i]), float(x[i] + rng.normal() * 0.05), float(rng.normal()), float(base[i]), int(rng.random() < p[i]), None if i % 3 else float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, epoch int, x double, twin double, junk double, p double, y int, holes double").cache()


def test_grouped_fits_equal_single_fits(world):
    rows = G.stacked(world, ["x", "junk", "holes"], {"a": ("p", "y"), "b": ("p", "y")}, ["epoch"])
    got = G.grouped_logistic(rows, ["feature", "line"], ["lp", "x"], "y")
    assert len(got) == 6
    for f in ("x", "junk", "holes"):
        one = fit.logistic(rows.filter((F.col("feature") == f) & (F.col("line") == "a")), ["lp", "x"], "y")
        assert np.allclose(got[(f, "a")], one.coef, atol=1e-6) and np.allclose(got[(f, "b")], one.coef, atol=1e-6)


def test_models_of_all_splits_are_fitted_in_one_pass_a_round(spark, world):
    """Equal to single fits on rows with holes, and no more jobs for three splits than for one."""
    e = F.col("epoch")
    df = world.withColumn("y2", F.when(F.col("id") % 5 > 0, 1 - F.col("y"))).withColumn("junk", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("junk")))
    lines, splits = {"a": ("p", "y"), "b": ("p", "y2")}, {"a": (e <= 2, e >= 3), "b": (e >= 3, e <= 2), "c": (e <= 3, e == 4)}

    def counted(which):
        spark.sparkContext.setJobGroup(f"gains of {len(which)}", "")
        out = G.held_out_gains(df, ["x", "junk", "holes"], lines, which)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gains of {len(which)}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, jobs

    got, jobs = counted(splits)
    assert jobs <= counted({"a": splits["a"]})[1] + 6
    for s, (train, test) in splits.items():
        for f in ("x", "junk", "holes"):
            rows = G.stacked(df, [f], lines, ["epoch"])
            one = {n: fit.logistic(rows.filter(train & (F.col("line") == n)), ["lp", "x"], "y").coef for n in lines}
            assert got[s][f]["coefficient"] == pytest.approx(one["b"][2], abs=1e-6) and got[s][f]["lines"] == 2
            base = rows.filter(test).groupBy("line").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("v")).agg(F.avg("v")).first()[0]
            q = {n: 1 / (1 + F.exp(-(F.lit(float(b[0])) + float(b[1]) * F.col("lp") + float(b[2]) * F.col("x")))) for n, b in one.items()}
            model = rows.filter(test).withColumn("q", F.when(F.col("line") == "a", q["a"]).otherwise(q["b"])).groupBy("line").agg(F.avg((F.col("q") - F.col("y")) ** 2).alias("v")).agg(F.avg("v")).first()[0]
            assert got[s][f]["base"] == pytest.approx(base, abs=1e-9) and got[s][f]["augmented"] == pytest.approx(model, abs=1e-6)


def test_gates_tell_signal_junk_twins_and_leaks_apart(world):
    e = F.col("epoch")
    splits = {"a": (e <= 2, e >= 3), "b": (e >= 3, e <= 2), "c": (e <= 3, e == 4)}
    claims = {"x": G.Claim(1, "weak"), "twin": G.Claim(1, None, ("x",)), "junk": G.Claim(0), "holes": G.Claim(-1)}
    out = {r["feature"]: r for r in G.feature_gates(world, claims, {"0.5": ("p", "y")}, splits, ["epoch"], {"x": 0, "twin": 0, "junk": 0, "holes": 0})}
    assert out["x"]["verdict"] == "PROMOTED" and out["x"]["coefficient"] == pytest.approx(0.8, abs=0.15)
    assert out["twin"]["failed_at"] == 4 and out["junk"]["failed_at"] == 2 and out["holes"]["failed_at"] == 3
    leaky = G.feature_gates(world, {"x": claims["x"]}, {"0.5": ("p", "y")}, splits, ["epoch"], {"x": 12})[0]
    assert (leaky["verdict"], leaky["failed_at"]) == ("REJECTED", 1)


def test_too_few_rows_give_no_gain(world):
    e = F.col("epoch")
    out = G.feature_gates(world.filter("id < 40"), {"x": G.Claim(1)}, {"0.5": ("p", "y")}, {"a": (e <= 2, e >= 3), "b": (e >= 3, e <= 2)}, ["epoch"], {"x": 0})[0]
    assert out["gain_a"] is None and out["gate2"] is False and out["gate3"] is None


def test_probe_finds_the_planted_leak(spark):
    out = {r.feature: r.changed_rows for r in Q.leak_probe(spark, SF).collect()}
    assert out.pop("same_day") > 0 and set(out.values()) == {0}


# --- dives -------------------------------------------------------------------------------------------


def complete(spark, terms):
    rows = Q.screen(spark, SF).select("epoch", "s", *terms).dropna().orderBy("epoch").collect()
    return np.array([r.epoch for r in rows]), np.array([[float(v) for v in r[2:]] for r in rows]), np.array([float(r.s) for r in rows])


def refit(epoch, x, y, columns, train, test):
    """RMSE on the test rows, coefficients and t values on the training rows, by least squares on the rows themselves."""
    a, b = np.isin(epoch, list(train)), np.isin(epoch, list(test))
    design = lambda m: np.column_stack([np.ones(m.sum()), x[m][:, columns]])
    coef = np.linalg.lstsq(design(a), y[a], rcond=None)[0]
    res = y[a] - design(a) @ coef
    se = np.sqrt(np.diag(np.linalg.pinv(design(a).T @ design(a))) * (res @ res) / (a.sum() - len(coef)))
    return math.sqrt(np.mean((y[b] - design(b) @ coef) ** 2)), coef, coef / se


@pytest.fixture(scope="module")
def screened(spark):
    terms = [*Q.BASE, "a_whiff", "is_home", "load3"]
    by = D.moments(Q.screen(spark, SF), terms, "s", "epoch")
    return terms, by, complete(spark, terms)


def test_subset_models_equal_refits(screened):
    terms, by, (epoch, x, y) = screened
    splits = {"a": ({1, 2}, {3}), "b": ({3, 4}, {1, 2})}
    got = {r["term"]: r for r in D.joint_drop_one(by, terms[:3], terms[3:], splits)}
    for s, (train, test) in splits.items():
        full, coef, t = refit(epoch, x, y, list(range(len(terms))), train, test)
        for i, name in enumerate(terms):
            less = refit(epoch, x, y, [j for j in range(len(terms)) if j != i], train, test)[0]
            assert got[name][f"gain_pct_{s}"] == pytest.approx(100 * (less - full) / less, abs=1e-6)
            assert got[name][f"coef_{s}"] == pytest.approx(coef[1 + i], abs=1e-7) and got[name][f"t_{s}"] == pytest.approx(t[1 + i], abs=1e-5)
        base = refit(epoch, x, y, [0, 1, 2], train, test)[0]
        assert got["survivors"][f"gain_pct_{s}"] == pytest.approx(100 * (base - full) / base, abs=1e-6)
    models = D.variants(by, {"two": terms[:2], "all": terms}, splits)
    assert models[0]["rmse_b"] == pytest.approx(refit(epoch, x, y, [0, 1], *splits["b"])[0], abs=1e-9)


def test_candidates_at_a_line_equal_refits(spark, screened):
    terms, _, (epoch, x, y) = screened
    splits = {"a": ({1, 2}, {3})}
    got = {r["term"]: r for r in D.candidate_screen(Q.screen(spark, SF).select("epoch", "s", *terms), terms[:3], terms[3:], "s", "epoch", splits)}
    train, test = np.isin(epoch, [1, 2]), epoch == 3
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))

    def predict(columns):
        design = lambda m: np.column_stack([np.ones(m.sum()), x[m][:, columns]])
        coef = np.linalg.lstsq(design(train), y[train], rcond=None)[0]
        return design(test) @ coef, math.sqrt(np.mean((y[train] - design(train) @ coef) ** 2))

    p0, sd0 = predict([0, 1, 2])
    half = np.floor(np.abs(p0) * 2 + 0.5) * np.sign(p0) / 2
    line = np.where(half == np.floor(half), half + 0.5, half)
    over = (y[test] > line).astype(float)
    for i, name in enumerate(terms[3:]):
        p1, sd1 = predict([0, 1, 2, 3 + i])
        brier = [np.mean((over - np.array([1 - cdf(v) for v in (line - p) / sd])) ** 2) for p, sd in ((p0, sd0), (p1, sd1))]
        d = (y[test] - p0) ** 2 - (y[test] - p1) ** 2
        assert got[name]["brier_gain_a"] == pytest.approx(brier[0] - brier[1], abs=1e-6)
        assert got[name]["paired_t_a"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))), abs=1e-6)
        assert got[name]["residual_r_a"] == pytest.approx(np.corrcoef(x[test][:, 3 + i], y[test] - p0)[0, 1], abs=1e-6)


def test_parsimony_drops_the_cheapest_term_first(screened):
    terms, by, (epoch, x, y) = screened
    splits = {"a": ({1, 2}, {3}), "b": ({3, 4}, {1, 2})}
    path = D.parsimony(by, terms, splits, 0.0)
    assert [r["terms"] for r in path] == list(range(len(terms), 0, -1))
    first = {s: refit(epoch, x, y, list(range(len(terms))), *v)[0] for s, v in splits.items()}
    loss = {}
    for i, name in enumerate(terms):
        rest = [j for j in range(len(terms)) if j != i]
        loss[name] = max(100 * (refit(epoch, x, y, rest, *v)[0] - first[s]) / first[s] for s, v in splits.items())
    assert path[1]["dropped"] == min(loss, key=lambda t: (loss[t], t)) and path[1]["worst_loss_pct"] == pytest.approx(min(loss.values()), abs=1e-6)


def test_add_one_finds_the_term_that_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 4)), float(a), float(b), float(a + 0.5 * b + rng.normal())) for a, b in rng.normal(size=(900, 2))]
    df = spark.createDataFrame(rows, "epoch int, a double, b double, y double").withColumn("c", F.pmod(F.xxhash64("a"), F.lit(100)) / 100)
    out = D.add_one(D.moments(df, ["a", "b", "c"], "y", "epoch"), ["a"], ["b", "c"], {"x": ({1}, {2}), "y": ({2}, {3})})
    assert [(r["term"], r["verdict"]) for r in out] == [("b", "SURVIVOR"), ("c", "REJECT")]


def test_shuffled_values_are_a_permutation_within_groups(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), i * i) for i in range(600)], "key long, epoch int, v double, other long").repartition(5)
    once, again = (D.shuffled(df, "v", ["epoch"], "key", 7, 40).orderBy("key").collect() for _ in range(2))
    assert once == again and [r.other for r in once] == [i * i for i in range(600)] and df.columns == list(once[0].asDict())
    for e in range(3):
        assert sorted(r.v for r in once if r.epoch == e) == [float(i) for i in range(600) if i % 3 == e]
    assert np.mean([r.v == r.key for r in once]) < 0.1
    assert [r.v for r in D.shuffled(df, "v", ["epoch"], "key", 8, 40).orderBy("key").collect()] != [r.v for r in once]


# --- the screen table --------------------------------------------------------------------------------


def test_screen_features_are_strictly_before(spark, tmp_path):
    """Events from a day on are altered: no feature of a row up to that day changes."""
    edge = "2024-01-15"
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = F.to_date("ts") >= F.lit(edge).cast("date")
    events.withColumn("event_type", F.when(late, F.lit("purchase")).otherwise(F.col("event_type"))).withColumn("value", F.when(late, 100 - F.col("value")).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    features = [*Q.WHOLE, *Q.REAL]
    rows = lambda sf: {(r.entity, r.day): tuple(r[f] for f in features) for r in Q.screen(spark, sf).filter(F.col("day") <= F.lit(edge).cast("date")).collect()}
    a, b = rows(SF), rows(str(tmp_path))
    assert len(a) > 100 and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], nan_ok=True), k


def test_shrunk_rates_by_hand(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01", 10, 4), (2, 1, "2024-01-01", 10, 0), (1, 1, "2024-01-02", 5, 5), (1, 2, "2024-01-09", 8, 8), (1, 1, "2024-01-03", 1, 1)], "t int, epoch int, d string, n int, h int").withColumn("day", F.to_date("d"))
    got = {(r.t, str(r.day)): (r.rate, r.mean) for r in T.shrunk_rates(df, ["t"], "epoch", "day", {"rate": T.Rate("h", "n", 10), "mean": T.Rate("h", "n")}, 1).collect()}
    assert got[(1, "2024-01-01")] == (None, None) and got[(1, "2024-01-09")] == (None, None)
    assert got[(1, "2024-01-02")] == (pytest.approx((4 + 10 * 0.2) / 20), pytest.approx(0.4))
    assert got[(1, "2024-01-03")] == (pytest.approx((9 + 10 * 9 / 25) / 25), pytest.approx(0.6))
