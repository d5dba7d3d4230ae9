"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and
one bit for each failed rule, so that a policy (a set of rules under a version
name) is a mask: applying another policy, or asking what a policy would drop
without one of its rules, reads the bits and never the texts again.

Everything on the path is a column expression; documents are never shuffled.

Edge cases: a null or empty text has no words and fails ``few_words``; a very long text
is measured whole, in the one row that it is (its arrays of words and windows are held
once); repeated rows are judged alike and all stay in the ledger; other columns pass
through, whatever their names (dots too), unless they have the name of a ledger column,
which then holds the ledger's value; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorframe.llm.common import BLANKS, boxed, table, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: Column

    @property
    def mask(self) -> int:
        return 1 << self.bit


def rules() -> list[Rule]:
    """All rules over the measurement columns. A bit is never given to another rule."""
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 10),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule(2, "symbol_heavy", c("n_symbols") > c("n_words")),
        Rule(3, "duplicate_lines", 2 * c("n_dup_lines") > c("n_lines")),
        Rule(4, "word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule(5, "capitals", 2 * c("n_capitals") > c("word_chars")),
    ]


#: Versioned policies: the rules whose failure drops a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length", "capitals"),
}


def policy_mask(policy: str) -> int:
    by_name = {r.name: r.mask for r in rules()}
    return sum(by_name[name] for name in POLICIES[policy])


def _dropped(text: Column, chars: str) -> Column:
    """Number of characters of text that are among chars."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _repeat_positions(sorted_windows: Column) -> Column:
    """Start positions, in order, of the windows that occur twice or more."""

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(sorted_windows, i - 1), F.get(sorted_windows, i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(sorted_windows, twice), lambda x: x["i"]))


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurement columns to docs, whose own names can't clash with any on the way."""
    box = boxed(docs, F.col(f"`{text}`").alias("text"), names=[c for c in docs.columns if c not in (*MEASURES, "failed_bits")])
    names = ["row"]
    whole = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, " " + BLANKS, "") != "")
    step = box.select(*names, words_of(F.col("text")).alias("_words"), lines.alias("_lines"), whole.alias("_whole"))
    count = F.size("_words")
    windows = F.when(count >= WINDOW, F.transform(F.sequence(F.lit(1), count - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    step = step.select(
        *names,
        count.cast("long").alias("n_words"),
        F.char_length(F.translate("_whole", " " + BLANKS, "")).cast("long").alias("word_chars"),
        _dropped(F.col("_whole"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _dropped(F.col("_whole"), CAPITALS).alias("n_capitals"),
        windows.alias("_windows"),
    )
    # Most documents repeat no window: a hash set tells, and only the others are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    kept = [*names, *(m for m in MEASURES if m != "n_repeat_words")]
    step = step.select(*kept, ordered.alias("_ordered"))
    step = step.select(*kept, _repeat_positions(F.col("_ordered")).alias("_starts"))
    repeated = F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long")
    return step.select(*kept, repeated.alias("n_repeat_words")).select("row.*", *MEASURES)


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and failed_bits, one bit for each failed rule."""
    bits = sum((F.when(r.failed, F.lit(r.mask)).otherwise(F.lit(0)) for r in rules()), F.lit(0))
    return measure(docs, text).withColumn("failed_bits", bits.cast("long"))


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Add kept: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def keep_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Rows of docs that no rule of the policy fails, with their own columns, whatever their names.

    The condition is tied to the partition's number, which is never negative: a filter
    on it stays above the measurements, where otherwise the optimizer would copy the
    tree of all rules into it once for every use of a measurement.
    """
    ledger = apply_policy(rule_ledger(boxed(docs, F.col(f"`{text}`").alias("text"))), policy)
    kept = ledger.select("row", (F.col("kept") & (F.spark_partition_id() >= 0)).alias("kept"))
    return kept.filter("kept").select("row.*")


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it drops, and that the policy drops with and without it.

    The ledger is first counted by failed_bits, of which there are at most two to
    the number of rules; all else is bitwise work on those counts.
    """
    mask = policy_mask(policy)
    counts = ledger.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    members = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in rules() if r.mask & mask))
    rows = counts.select("failed_bits", "n", F.explode(members).alias("r")).select("failed_bits", "n", "r.rule", "r.bit")
    bits, bit = F.col("failed_bits"), F.col("bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(
        total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        total(bits.bitwiseAND(F.lit(mask)) == bit).alias("n_only_this"),
        total(bits.bitwiseAND(F.lit(mask)) != 0).alias("n_dropped"),
        total(bits.bitwiseAND(F.lit(mask).bitwiseXOR(bit)) != 0).alias("n_dropped_without"),
        F.bit_or(F.when(bits.bitwiseAND(bit) != 0, bits)).alias("fails_together"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed_bits").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return ledger.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "failed_bits")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n
        FROM (SELECT rid, i, unnest(range(0, 5)) AS o FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^ 	-
]') GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f
"""



def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does to the whole table."""
    return ablations(rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


ABLATIONS_SQL = f"""
WITH q AS ({OP2_SQL}),
r AS (SELECT rule, CAST(bit AS BIGINT) AS bit
      FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbol_heavy', 4), ('duplicate_lines', 8), ('word_length', 16), ('capitals', 32)) t(rule, bit))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only_this,
       count(*) FILTER (failed_bits <> 0) AS n_dropped, count(*) FILTER (failed_bits & ~bit <> 0) AS n_dropped_without,
       bit_or(failed_bits) FILTER (failed_bits & bit <> 0) AS fails_together
FROM q, r GROUP BY rule
"""

QUERIES = {"op2_quality_rules": op2_quality_rules, "quality_ablations": quality_ablations}
SQL = {"op2_quality_rules": OP2_SQL, "quality_ablations": ABLATIONS_SQL}
