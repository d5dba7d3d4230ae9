"""Secret scanner: known forms plus a randomness test battery.

Known forms are found by regular expressions (``assign``, ``access``, ``hex``).
All other long tokens are candidates: the encoding of each is inferred from its
characters, and three tests ask whether it looks uniformly random over that
alphabet (chi-squared of the character counts, runs about the middle of the
alphabet, lag-one serial correlation). Fisher's method joins the three.

A token is reported where randomness is not rejected and natural strings of its kind
rarely look as random. The natural ones are made of the corpus itself: all words of
every document, written without blanks, block after block in one of the encodings (lower
or upper case, capitalized, with separators, as digits) and cut at a length. Their p-values
are the null distribution of an encoding and length; where a length has fewer than
``ENOUGH`` of them, the next shorter lengths, which look more random, are added. A
token's null p-value is the share (plus one string) of natural strings at least as
random; all candidates are then cut by Benjamini and Hochberg's rule at ``fdr``, so
each token is judged by itself and by its length, whatever else is in its stratum,
and none is reported where nothing natural was seen.

All work is column expressions; the texts are read twice and never shuffled. What
goes to the driver is one count for each encoding, length bin and hundredth of p.

Edge cases: a null or empty text has no spans; very long texts are scanned whole, in
time proportional to their matches (positions are summed in blocks); repeated rows
are scanned alike and all stay; a candidate that overlaps a known form adds nothing;
an empty table gives no rows; the operator reads two columns only, so names of others
cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.common import let, materialize, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of fewer than 16 fail in any case, and a maximal run of 16 or more is the same match.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
LENGTH_BINS = (24, 28, 32, 40, 48, 64, 96)
#: The length that candidates start at, the words that are written in one encoding, and how many natural strings of a length are enough.
SHORTEST, BLOCK, ENOUGH = 20, 64, 100


#: Matches whose positions are summed in one pass.
SPAN_BLOCK = 64
SPAN = "struct<start:int,end:int,kind:int,hit:string>"


def match_spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column]) -> Column:
    """Spans (start, end, kind, hit) of the matches that keep(match, index) accepts, in code points.

    The pieces between matches and the matches themselves, in turn, are the text, so
    their running lengths are the positions: summed within blocks, then over blocks.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["hit"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), m["hit"].alias("hit"), m["ok"].alias("ok"))).alias("spans"))

    empty = F.array().cast("array<struct<start:int,end:int,hit:string,ok:boolean>>")
    summed = lambda pairs: F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)
    pairs = let(pieces, lambda p: F.transform(found, lambda hit, i: F.struct(F.get(p, i).alias("gap"), hit.alias("hit"), keep(hit, i).alias("ok"))))
    blocks = let(pairs, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SPAN_BLOCK).cast("int")), lambda k: summed(F.slice(v, k * SPAN_BLOCK + 1, SPAN_BLOCK))))

    def moved(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))
        shift = lambda b, at: F.transform(F.filter(b["spans"], lambda x: x["ok"]), lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit")))
        return let(before, lambda at: F.flatten(F.transform(parts, lambda b, i: shift(b, F.get(at, i)))))

    return F.when(text.rlike(pattern), let(blocks, moved)).otherwise(F.array().cast(f"array<{SPAN}>"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation of erf (error below 2e-7)."""
    # Abramowitz and Stegun 7.1.26.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = (series + c) * t
    upper = series * F.exp(-x * x) / 2
    return F.when(z > 0, 1 - upper).otherwise(upper)


def encoding_of(token: Column) -> Column:
    return (
        F.when(token.rlike("^[a-z]+$"), "lower")
        .when(token.rlike("^[A-Z]+$"), "upper")
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def battery(token: Column, encoding: Column) -> Column:
    """Encoding, length and joint p-value of the tests that token is uniformly random over the encoding's alphabet."""

    def tests(t: Column) -> Column:
        alphabet = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))[t["enc"]]
        size = F.char_length(alphabet).cast("double")
        chars = F.split(F.when(t["enc"] == "hex", F.lower(t["token"])).otherwise(t["token"]), "")
        return let(F.struct(F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1).alias("xs"), size.alias("a"), t["enc"].alias("enc")), joined)

    def joined(v: Column) -> Column:
        xs, a = v["xs"], v["a"]
        n = F.size(xs).cast("double")
        zero = F.lit(0.0)
        # The j-th of equal characters adds 2j - 1, so a run of c adds c squared.
        runs = F.aggregate(
            F.array_sort(xs), F.struct(F.lit(-1.0).alias("of"), zero.alias("j"), zero.alias("sq")),
            lambda acc, x: let(F.when(x == acc["of"], acc["j"] + 1).otherwise(1.0), lambda j: F.struct(x.alias("of"), j.alias("j"), (acc["sq"] + 2 * j - 1).alias("sq"))),
        )
        mean = F.aggregate(xs, zero, lambda acc, x: acc + x) / n
        high = F.size(F.filter(xs, lambda x: 2 * x >= a)).cast("double")
        neighbours = F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        turns = F.size(F.filter(neighbours, lambda p: (2 * p["x"] >= a) != (2 * p["y"] >= a))).cast("double")
        s = F.struct(n.alias("n"), a.alias("a"), runs["sq"].alias("sq"), mean.alias("mean"), high.alias("high"), turns.alias("turns"), xs.alias("xs"), neighbours.alias("nb"), v["enc"].alias("enc"))
        return let(s, verdict)

    def verdict(s: Column) -> Column:
        cov = F.aggregate(s["nb"], F.lit(0.0), lambda acc, p: acc + (p["x"] - s["mean"]) * (p["y"] - s["mean"]))
        dev = F.aggregate(s["xs"], F.lit(0.0), lambda acc, x: acc + (x - s["mean"]) * (x - s["mean"]))
        p = fisher(logs(*tails(*deviations(s["n"], s["a"], s["sq"], s["high"], s["turns"], cov, dev))))
        return F.struct(s["enc"].alias("enc"), s["n"].cast("int").alias("n"), F.when((s["high"] == 0) | (s["high"] == s["n"]), F.lit(0.0)).otherwise(p).alias("p"))

    return let(F.struct(token.alias("token"), encoding.alias("enc")), tests)


def deviations(n: Column, a: Column, squares: Column, high: Column, turns: Column, cov: Column, dev: Column) -> tuple[Column, Column, Column]:
    """Standard deviations from what is expected of n random places in an alphabet of a: of character counts (chi-squared, by the cube-root normal approximation), of runs and of serial correlation.

    squares: sum of squared character counts; high: characters of the alphabet's upper half; turns: neighbours in different halves.
    """
    spread = 2 / (9 * (a - 1))
    chi = (F.cbrt((a / n * squares - n) / (a - 1)) - (1 - spread)) / F.sqrt(spread)
    mu = 2 * high * (n - high) / n + 1
    var = F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9))
    return chi, F.abs(turns + 1 - mu) / F.sqrt(var), F.abs(cov / F.greatest(dev, F.lit(1e-9))) * F.sqrt(n)


def tails(chi: Column, runs: Column, serial: Column) -> tuple[Column, Column, Column]:
    return 1 - normal_cdf(chi), 2 * (1 - normal_cdf(runs)), 2 * (1 - normal_cdf(serial))


def logs(*p: Column) -> Column:
    """Half of Fisher's statistic."""
    return -sum(F.ln(F.greatest(x, F.lit(1e-12))) for x in p)


def fisher(half: Column) -> Column:
    """Joint p-value of three tests."""
    return F.exp(-half) * (1 + half + half * half / 2)


def battery_of_rows(strings: DataFrame) -> DataFrame:
    """Rows enc, n, p: battery for many short strings (token, enc; no longer than 191), in columns that compile.

    A character becomes that of its place from "0" on, so counts by character are what the string loses without it.
    """
    marks = "".join(chr(48 + i) for i in range(max(map(len, ALPHABETS.values()))))
    by_encoding = lambda made: F.coalesce(*(F.when(F.col("enc") == enc, made(letters)) for enc, letters in ALPHABETS.items()))
    plain = F.when(F.col("enc") == "hex", F.translate("token", "ABCDEF", "abcdef")).otherwise(F.col("token"))
    placed = strings.select("enc", plain.alias("token")).select("enc", by_encoding(lambda letters: F.translate("token", letters, marks[: len(letters)])).alias("t"))
    halves = by_encoding(lambda letters: F.translate("t", marks[: len(letters)], "".join(str(int(2 * i >= len(letters))) for i in range(len(letters)))))
    # One whole number holds the last place (7 bits) and the sums of places (14), of their squares (20) and of products of neighbours (20).
    step = lambda acc, x: F.shiftright(acc, 7) * 128 + x * (129 + (1 << 21) * x + (1 << 41) * acc.bitwiseAND(127))
    sums = F.aggregate(F.transform(F.split("t", ""), lambda c: (F.ascii(c) - 48).cast("long")), F.lit(0).cast("long"), step)
    without = lambda text, part: F.length(F.replace(text, F.lit(part), F.lit(""))).cast("double")
    size = F.length("t").cast("double")
    # Marks beyond an alphabet are not looked for.
    sizes = [0, *sorted({len(letters) for letters in ALPHABETS.values()})]
    some = lambda low, high: sum(F.pow(size - without(F.col("t"), c), F.lit(2.0)) for c in marks[low:high])
    squares = sum(F.when(by_encoding(lambda letters: F.lit(len(letters))) > low, some(low, high)).otherwise(0.0) for low, high in zip(sizes, sizes[1:]))
    counted = placed.select("enc", "t", size.alias("n"), halves.alias("halves"), squares.alias("sq"), sums.alias("sums"))
    field = lambda at, bits: F.shiftright("sums", at).bitwiseAND((1 << bits) - 1).cast("double")
    h = F.col("halves")
    facts = counted.select(
        "enc", "n", "sq", by_encoding(lambda letters: F.lit(float(len(letters)))).alias("a"), (F.col("n") - without(h, "1")).alias("high"), (F.col("n") - (without(h, "01") + without(h, "10")) / 2).alias("turns"),
        (F.ascii("t") - 48).cast("double").alias("first"), field(0, 7).alias("last"), field(7, 14).alias("x"), field(21, 20).alias("xx"), field(41, 20).alias("xy"),
    )
    mean = F.col("x") / F.col("n")
    cov = F.col("xy") - mean * (2 * F.col("x") - F.col("first") - F.col("last")) + (F.col("n") - 1) * mean * mean
    moments = facts.select("enc", "n", "sq", "a", "high", "turns", cov.alias("cov"), (F.col("xx") - mean * F.col("x")).alias("dev"))
    # Step by step: a column that the next step uses several times is computed once.
    kept = ["enc", F.col("n").cast("int").alias("n"), ((F.col("high") == 0) | (F.col("high") == F.col("n"))).alias("one_half")]
    named = lambda columns: [c.alias(f"v{i}") for i, c in enumerate(columns)]
    z = moments.select(*kept, *named(deviations(*(F.col(c) for c in ("n", "a", "sq", "high", "turns", "cov", "dev")))))
    p = z.select("enc", "n", "one_half", *named(tails(F.col("v0"), F.col("v1"), F.col("v2"))))
    half = p.select("enc", "n", "one_half", logs(F.col("v0"), F.col("v1"), F.col("v2")).alias("half"))
    return half.select("enc", "n", F.when(F.col("one_half"), F.lit(0.0)).otherwise(fisher(F.col("half"))).alias("p"))


def length_bin(n: Column) -> Column:
    return sum((F.when(n >= b, 1).otherwise(0) for b in LENGTH_BINS), F.lit(0))


def natural_strings(texts: DataFrame) -> DataFrame:
    """Rows token, enc: all words of the texts (column t), blocks of BLOCK words written in an encoding and cut at a length, both dealt by hash.

    The last block of a text and the last string of a block take what is left over; a block of fewer than SHORTEST characters makes none.
    """
    words = texts.select(F.xxhash64("t").alias("seed"), F.filter(F.split(F.lower("t"), "[^a-z]+"), lambda w: w != "").alias("words"))
    whole = F.greatest(F.floor(F.size("words") / BLOCK), F.lit(1)).cast("int")
    blocks = words.select("seed", "words", whole.alias("blocks"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("k"))
    last = F.col("k") + 1 == F.col("blocks")
    part = F.slice("words", F.col("k") * BLOCK + 1, F.when(last, F.lit(2 * BLOCK)).otherwise(F.lit(BLOCK)))
    dealt = blocks.select(part.alias("words"), F.pmod(F.xxhash64("seed", "k"), F.lit(1 << 30)).alias("place"))
    length = F.get(F.array(*(F.lit(n) for n in (SHORTEST, *LENGTH_BINS))), (F.col("place") % (len(LENGTH_BINS) + 1)).cast("int"))
    plain, which = F.array_join("words", ""), F.floor(F.col("place") / 64) % len(ALPHABETS)
    forms = {
        "hex": F.translate(plain, "abcdefghijklmnopqrstuvwxyz", "01234567890123456789012345"), "base32": F.upper(plain), "lower": plain, "upper": F.upper(plain),
        "alnum": F.array_join(F.transform("words", lambda w: F.initcap(w)), ""), "base64": F.array_join("words", "-"),
    }
    form, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (enc, made) in enumerate(forms.items()):
        form, name = F.when(which == i, made).otherwise(form), F.when(which == i, enc).otherwise(name)
    written = dealt.select(form.alias("form"), name.alias("enc"), length.alias("n")).filter(F.char_length("form") >= SHORTEST)
    pieces = F.greatest(F.floor(F.char_length("form") / F.col("n")), F.lit(1)).cast("int")
    cut = written.select("form", "enc", "n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("i"))
    size = F.when(F.col("i") + 1 == F.col("pieces"), 2 * F.col("n")).otherwise(F.col("n"))
    return cut.select(F.substr("form", F.col("i") * F.col("n") + 1, size).alias("token"), "enc")


def least_random(counts: list, fdr: float) -> dict[tuple[str, int], int]:
    """By encoding and length bin, the hundredth of p from which tokens are reported.

    counts: rows enc, bin, cent, natural, n of natural strings and candidates.
    """
    natural: dict[tuple[str, int], np.ndarray] = {}
    cells = []
    for r in counts:
        if r["natural"]:
            natural.setdefault((r["enc"], r["bin"]), np.zeros(101, np.int64))[r["cent"]] += r["n"]
        else:
            cells.append((r["enc"], r["bin"], r["cent"], r["n"]))

    def null_p(enc: str, at: int, cent: int) -> float:
        pool = np.zeros(101, np.int64)
        for k in range(at, -1, -1):
            pool += natural.get((enc, k), 0)
            if pool.sum() >= ENOUGH:
                break
        return float(1 + pool[cent:].sum()) / float(1 + pool.sum())

    judged = sorted((null_p(enc, at, cent), enc, at, cent, n) for enc, at, cent, n in cells)
    total, ranks = sum(c[-1] for c in judged), np.cumsum([c[-1] for c in judged])
    good = [i for i, c in enumerate(judged) if c[0] * total <= fdr * ranks[i]]
    out: dict[tuple[str, int], int] = {}
    for _, enc, at, cent, _ in judged[: good[-1] + 1] if good else []:
        out[enc, at] = min(cent, out.get((enc, at), 101))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", level: float = 0.05, fdr: float = 0.1) -> DataFrame:
    """One row for each row of docs: its id and spans, an array of (start, end, kind, hit) ordered by start and kind.

    kind indexes KINDS. level: a candidate whose joint p-value is below it is not random.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    always = lambda hit, i: F.lit(True)
    read = docs.select(F.col(id_col).alias("id"), t.alias("t"))
    values = F.regexp_extract_all(F.col("t"), F.lit(ASSIGN), F.lit(2))
    base = F.concat(
        match_spans(F.col("t"), ASSIGN, 0, lambda hit, i: F.char_length(F.get(values, i)) >= 12),
        match_spans(F.col("t"), ACCESS, 1, lambda hit, i: F.char_length(hit) >= 18),
        match_spans(F.col("t"), HEX, 2, always),
    )
    tokens = match_spans(F.col("t"), CANDIDATE, 3, always)
    scored = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), battery(s["hit"], encoding_of(s["hit"])).alias("b")))
    found = materialize(read.select("id", base.alias("base"), scored.alias("cands")), "secrets")
    new = F.filter("cands", lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    cent = lambda b: F.floor(b["p"] * 100).cast("int")
    cell = lambda b, natural: F.struct(b["enc"].alias("enc"), length_bin(b["n"]).alias("bin"), cent(b).alias("cent"), F.lit(natural).alias("natural"))
    strings = battery_of_rows(natural_strings(read.select("t")))
    seen = found.select(F.explode(F.transform(new, lambda c: cell(c["b"], False))).alias("s")).unionByName(strings.select(cell({c: F.col(c) for c in strings.columns}, True).alias("s")))
    counts = seen.groupBy("s.enc", "s.bin", "s.cent", "s.natural").agg(F.count(F.lit(1)).alias("n")).collect()
    limits = least_random(counts, fdr)
    limit = F.create_map(*(F.lit(x) for (enc, at), c in sorted(limits.items()) for x in (f"{enc}/{at}", c))) if limits else F.create_map(F.lit(""), F.lit(101))
    kept = lambda b: (b["p"] > level) & F.coalesce(cent(b) >= F.try_element_at(limit, F.concat_ws("/", b["enc"], length_bin(b["n"]).cast("string"))), F.lit(False))
    more = F.transform(F.filter(new, lambda c: kept(c["b"])), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind"), c["hit"].alias("hit")))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", more), order).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), of(3).alias("n_random"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
