import re

from priorframe.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a b c d e " * 3, "a b c d e f a b c d e g", "x x x x x x", "one\ntwo\none\r\none\n \n \n",
    "é ü \U0001f600 # * $ % & | < >", "a b c d", "w " * 3000, "AAA BBB CCC DDD EEE FFF GGG HHH III JJJ KKK", "a\x00b c",
]


def ledger(spark, texts):
    return Q.apply_policy(Q.rule_ledger(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)))


def test_measures_match_brute_force(spark):
    got = {r.doc_id: r for r in ledger(spark, TEXTS).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in Q.MEASURES[:5]) == brute(t), t


def test_policies_read_the_bits(spark):
    rows = ledger(spark, TEXTS + TEXTS)
    for policy in Q.POLICIES:
        mask = Q.policy_mask(policy)
        assert all(r.kept == (r.failed_bits & mask == 0) for r in Q.apply_policy(rows, policy).collect())


def test_ablations_match_counting(spark):
    rows = ledger(spark, TEXTS * 3)
    bits = [r.failed_bits for r in rows.collect()]
    mask = Q.policy_mask("v1")
    by_name = {r.name: r.mask for r in Q.rules()}
    for r in Q.ablations(rows).collect():
        b = by_name[r.rule]
        assert r.n_failed == sum(x & b != 0 for x in bits)
        assert r.n_only_this == sum(x & mask == b for x in bits)
        assert r.n_dropped == sum(x & mask != 0 for x in bits)
        assert r.n_dropped_without == sum(x & mask & ~b != 0 for x in bits)


def test_empty_table_and_plan(spark):
    empty = ledger(spark, [])
    assert empty.collect() == []
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
