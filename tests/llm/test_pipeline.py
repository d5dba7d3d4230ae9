import corpus_pipeline as P

from priorframe.llm.quality_rules import apply_policy, rule_ledger
from tests.llm import test_decontaminate, test_line_dedup, test_near_dup, test_quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        rows = list(before.items())
        if name != "source mix":
            assert docs.columns == columns
        if name == "quality rules":
            ledger = {r.doc_id: r for r in apply_policy(rule_ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
            base = {i for i, t in rows if (m := test_quality_rules.brute(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
            assert set(after) == {i for i in before if ledger[i].kept} and not set(after) & base
        elif name == "line dedup":
            gone = test_line_dedup.brute(rows)
            want = {}
            for i, t in rows:
                lines = [x for j, x in enumerate(t.split("\n")) if j not in gone.get((i, t), [])]
                if any(x.strip() for x in lines):
                    want[i] = "\n".join(lines)
            assert sum(after.get(i) == t for i, t in want.items()) >= 0.97 * len(want) and len(set(after) ^ set(want)) <= 0.03 * len(want)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near-dedup":
            assert {str(i) for i in after} == {c for _, c, _ in test_near_dup.brute_classes(rows)}
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, t in rows if not test_decontaminate.brute(t, benchmark)[4]}
        else:
            assert all(1 <= r.mix_copies <= 3 for r in docs.collect()) and set(after) <= set(before)


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run and "pipeline" not in entry.oracle_sql()
    assert P.run(spark, SF).count() > 50
