import hashlib
import random
from collections import Counter

import pytest

from priorframe.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, node string"


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def found(rows, cuts):
    lost = {r.node: r for r in cuts.collect()}
    out = []
    for r in rows.collect():
        c = lost.get(r.node)
        out.append((str(r.id), r.n_bytes, c.n_removed if c else 0, c.n_spans if c else 0, hashlib.sha256(bytes(c.kept)).hexdigest() if c else r.sha256))
    return sorted(out)


def fixture(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passages = [piece(rng.randint(15, 90)) for _ in range(5)]
    rows = []
    for i in range(70):
        text = piece(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "X"
            a = rng.randint(0, 10)
            text += "".join(p[a:]) + piece(rng.randint(0, 25))
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "z" * 300), (903, "z" * 19), (904, "z" * 20), (905, rows[5][1]), (5, rows[5][1]), (None, piece(50)), (906, passages[0]), (906, passages[0])]
    return rows


@pytest.mark.parametrize("seed, segment", [(1, 1 << 20), (2, 64)])
def test_fixture_matches_brute_force(spark, seed, segment):
    rows = fixture(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert found(*S.remove_repeats(df, length=20, gram=6, block=4, segment=segment)) == brute(rows, 20)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = S.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 400)


def test_empty_table(spark):
    rows, cuts = S.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert rows.collect() == [] and cuts.collect() == []
