"""Extra columns with the names that operators use themselves come back as they were."""

import pytest

import corpus_pipeline as P

from priorframe.llm.line_dedup import drop_duplicate_lines
from priorframe.llm.mixing import mix_documents
from priorframe.llm.near_dup import keep_one_of_each, label_documents
from priorframe.llm.quality_classifier import score_documents as score_quality, train as train_quality
from priorframe.llm.quality_rules import keep_documents, rule_ledger
from priorframe.llm.toxicity import score_documents as score_toxicity, train as train_toxicity

SF = "/root/testdata/sf0.001"
OWN = (
    "row", "doc", "removed", "kept", "maybe", "node", "label", "id", "size", "copies", "_doc", "_label", "_id", "_row", "_text", "_words", "_lines", "_whole", "_windows", "_ordered", "_starts",
    "_kept", "_lang", "lang", "hit_spans", "items", "a.b", "x y",
)
LONG = "one two three four five six seven eight nine ten eleven twelve"


def docs(spark):
    texts = [LONG, LONG, "alpha beta\n" + LONG, "gamma delta epsilon zeta eta theta", None, ""]
    rows = [(i, t, "s", *(f"{c}{i}" for c in OWN)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in OWN)}")


def scored(train, score):
    labels = "doc_id long, quality int, toxic int"
    return lambda df: score(df, train(df, df.sparkSession.createDataFrame([(i, i % 2, i % 2) for i in range(6)], labels)))


WORKS = [drop_duplicate_lines, keep_one_of_each, label_documents, mix_documents, keep_documents, rule_ledger, scored(train_quality, score_quality), scored(train_toxicity, score_toxicity)]


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_of_the_pipeline(spark, stage):
    """Clashing and dotted names, null, empty and blank texts, repeated rows, a long text; then no rows at all."""
    df = docs(spark)
    more = [(None, None), (7, " \n"), (8, "word " * 30_000), (8, "word " * 30_000), (9, "only one of its kind, in ten words or more, as a rule asks"), (9, "only one of its kind, in ten words or more, as a rule asks")]
    df = df.unionByName(spark.createDataFrame([(i, t, None, *(f"{c}{i}" for c in OWN)) for i, t in more], df.schema)).repartition(3)
    out = stage(spark, df, SF)
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in OWN) and (9 in {r.doc_id for r in rows} or "mix_copies" in out.columns)
    none = stage(spark, df.limit(0), SF)
    assert none.columns == out.columns and none.collect() == []


def test_clashing_names(spark):
    for work in WORKS:
        df = docs(spark)
        got = work(df)
        assert got.columns[: len(df.columns)] == df.columns
        for r in got.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in OWN)


def test_lines_and_classes_of_that_table(spark):
    left = {r.doc_id: r.text for r in drop_duplicate_lines(docs(spark)).collect()}
    assert left == {0: LONG, 2: "alpha beta", 3: "gamma delta epsilon zeta eta theta", 4: None, 5: ""}
    # Document 2 shares 8 of 10 shingles with document 0.
    assert sorted(r.doc_id for r in keep_one_of_each(docs(spark)).collect()) == [0, 3, 4]
