import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from priorframe.llm import secret_scan as S

SCHEMA = "doc_id long, text string, spans string"


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def check(rows, got):
    assert len(rows) == len(got)
    want = sorted((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == want


def run(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return S.op1_secret_scan(spark, str(tmp_path)).collect()


def test_base_spans_match_regular_expressions(spark, tmp_path):
    rng = random.Random(3)
    parts = ["password=", "secret : ", "TOKEN='", "api_key=", "é", "\U0001f600", "AKIA", "x" * 12, "0123456789abcdef", "secret=token=abcdefghijkl", "secret=token: abcdefghijklmnop", " ", "\n", "ABCDEFGHIJ0123456789", '"', "deadbeefdeadbeef0"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "0" * 100_000), (1002, "0" * 100_000), (None, "token=aaaaaaaaaaaa")]
    got = run(spark, spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA), tmp_path)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=key) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], S.op1_secret_scan(spark, "/root/testdata/sf0.001").collect())


ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"alnum": ALNUM, "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": ALNUM + "+/", "lower": "abcdefghijklmnopqrstuvwxyz"}
SYLLABLES = ["the", "an", "er", "tion", "ing", "ha", "st", "o", "re", "nd", "ma", "li"]


def planted(seed=5, n=40, size=48):
    """Rows (doc_id, text): prose, random tokens of four alphabets within prose, and natural strings that look long."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(60))
    rows, truth = [(i, prose()) for i in range(1500)], {}
    for name, alphabet in ALPHABETS.items():
        for _ in range(n):
            token, i = "".join(rng.choice(alphabet) for _ in range(size)), len(rows)
            rows.append((i, f"{prose()} {token} {prose()}"))
            truth[i] = name
    forms = [lambda: "".join(word() for _ in range(9)), lambda: "/".join(word() for _ in range(9)), lambda: "-".join(word() for _ in range(9)), lambda: "".join(word().capitalize() for _ in range(9)), lambda: "x1" + "".join(word() for _ in range(9))]
    rows += [(len(rows) + i, prose() + " " + forms[i % 5]()) for i in range(400)]
    return rows, truth


def test_random_tokens_are_found_and_natural_ones_are_not(spark, tmp_path):
    rows, truth = planted()
    for more in ([], [(9000, "w" * 60), (9001, "".join(SYLLABLES) * 3)], [(9100 + i, "/".join(["usr", "share", "the", "ning", "station", f"handler{i}"] * 2)) for i in range(300)]):
        got = {r.doc_id: r.n_random for r in run(spark, spark.createDataFrame([(i, t, "") for i, t in rows + more], SCHEMA), tmp_path)}
        for name in ("alnum", "base64", "base32"):
            found = sum(got[i] == 1 for i, x in truth.items() if x == name)
            assert found >= 30, (name, found, len(more))
        false = sum(n for i, n in got.items() if i not in truth)
        assert false <= 0.1 * sum(got.values()), (false, sum(got.values()), len(more))


def test_battery_matches_plain_python(spark):
    """Chi-squared, runs and serial correlation of each token, by loops."""
    rng = random.Random(2)
    rows = [(e, "".join(rng.choice(S.ALPHABETS[e]) for _ in range(rng.choice((20, 33, 64))))) for e in S.ALPHABETS for _ in range(5)]
    cdf = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
    df = spark.createDataFrame(rows, "enc string, token string")
    for r in df.select("enc", "token", S.battery(F.col("token"), F.col("enc")).alias("b")).collect():
        xs, a = [S.ALPHABETS[r.enc].index(c) for c in r.token], len(S.ALPHABETS[r.enc])
        n, mean = len(xs), sum(xs) / len(xs)
        chi = a / n * sum(c * c for c in Counter(xs).values()) - n
        spread = 2 / (9 * (a - 1))
        p = [1 - cdf(((chi / (a - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread))]
        high = [2 * x >= a for x in xs]
        k, turns = sum(high), 1 + sum(x != y for x, y in zip(high, high[1:]))
        mu = 2 * k * (n - k) / n + 1
        p.append(2 * (1 - cdf(abs(turns - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)))))
        corr = sum((x - mean) * (y - mean) for x, y in zip(xs, xs[1:])) / sum((x - mean) ** 2 for x in xs)
        p.append(2 * (1 - cdf(abs(corr) * math.sqrt(n))))
        half = -sum(math.log(max(x, 1e-12)) for x in p)
        assert r.b.p == pytest.approx(math.exp(-half) * (1 + half + half * half / 2), abs=1e-4)


def test_battery_of_rows_equals_the_battery(spark):
    rng = random.Random(4)
    rows = [(e, "".join(rng.choice(S.ALPHABETS[e][:k]) for _ in range(n))) for e in S.ALPHABETS for k in (1, 3, 99) for n in (20, 33, 191)] + [("hex", "0123456789ABCDEFAB" * 2)]
    df = spark.createDataFrame(rows, "enc string, token string")
    want = [tuple(r.b) for r in df.select(S.battery(F.col("token"), F.col("enc")).alias("b")).collect()]
    got = [tuple(r) for r in S.battery_of_rows(df).collect()]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)


def test_natural_strings_are_made_of_all_words(spark):
    """Every letter of every text is in a string, but for texts and blocks of fewer than 20 characters."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (30, 64, 65, 127, 128, 700, 5000)] + ["", "Too few, words", "ab" * 30 + "\né" * 100]
    for text in texts:
        got = S.natural_strings(spark.createDataFrame([(text,)], "t string")).collect()
        words = re.findall("[a-z]+", text.lower())
        blocks = max(len(words) // S.BLOCK, 1)
        parts = [words[k * S.BLOCK : (k + 1) * S.BLOCK if k + 1 < blocks else None] for k in range(blocks)]
        want = Counter(len("".join(p)) for p in parts if len("".join(p)) >= S.SHORTEST)
        letters = sum(len(r.token.replace("-", "")) for r in got)
        assert letters == sum(n * k for n, k in want.items()) and all(S.SHORTEST <= len(r.token) < 2 * S.LENGTH_BINS[-1] for r in got)


def test_cut_of_the_false_discovery_control():
    row = lambda enc, at, cent, natural, n: {"enc": enc, "bin": at, "cent": cent, "natural": natural, "n": n}
    nulls = [row("alnum", 3, 0, True, 990), row("alnum", 3, 20, True, 10)]
    # At cent 50 the null p-value is 1/1001, at 10 it is 11/1001, at 0 it is 1.
    assert S.least_random([*nulls, row("alnum", 3, 50, False, 10), row("alnum", 3, 0, False, 500)], 0.1) == {("alnum", 3): 50}
    assert S.least_random([*nulls, row("alnum", 3, 50, False, 50), row("alnum", 3, 10, False, 50), row("alnum", 3, 0, False, 5)], 0.1) == {("alnum", 3): 10}
    # Nothing natural of this encoding: nothing is reported.
    assert S.least_random([*nulls, row("base64", 3, 90, False, 5)], 0.1) == {}


def test_empty_table(spark, tmp_path):
    assert run(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []
