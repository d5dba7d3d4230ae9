import hashlib
import random
import re

import pytest

from priorframe.llm import decontaminate as D, textkit

DOCS = "doc_id long, text string, items string, n_chars long"
ITEMS = "item_id long, text string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, benchmark):
    w, hit, items = words(text), set(), set()
    for item, t in benchmark:
        iw = words(t)
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(11)
    vocabulary = ["aa", "b", "Cc", "dd9", "é", "Ünder", "x" * 40, "0"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "'"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(100, ""), (101, None), (None, text(14)), (3, text(20)), (200, "solo"), (10, text(12)), (10, text(12))]
    docs = [(i, text(rng.randint(0, 60)), "clash", 1) for i in range(60)]
    for i in range(60):
        part = words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(part) - 8))
        docs.append((1000 + i, text(rng.randint(0, 12)) + " " + " ".join(part[a : a + rng.randint(5, 25)]).upper() + " " + text(5), None, None))
    docs += [(None, None, None, None), (5000, "", None, None), (5001, "solo", None, None), (5001, "solo", None, None), (5002, "... ---", None, None), (6000, text(30000), None, None)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, block_bytes):
    docs, items = fixture()
    got = D.mark_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "n_chars", "n_words", "hit_spans", "items"]
    rows = got.collect()
    assert len(rows) == len(docs)
    seen = {(r.doc_id, r.text): (r.n_words, sum(s.end - s.start for s in r.hit_spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hit_spans)) for r in rows}
    for i, t, _, _ in docs:
        if t is None or len(t) < 10_000:
            assert seen[(i, t)] == brute(t, items), (i, t)


def test_short_windows_of_long_text(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(20000)]
    items = [(i, " ".join(base[at : at + 12])) for i, at in enumerate((0, 9000, 19988))]
    row = D.mark_contamination(spark.createDataFrame([(1, " ".join(base), "", 1)], DOCS), spark.createDataFrame(items, ITEMS)).first()
    assert [(s.start, s.end) for s in row.hit_spans] == [(0, 12), (9000, 9012), (19988, 20000)] and row["items"] == ["0", "1", "2"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert D.mark_contamination(spark.createDataFrame([], DOCS), none).collect() == []
    assert D.mark_contamination(spark.createDataFrame([(1, "a b", "", 1)], DOCS), none).first().hit_spans == []


def test_blocks_hold_no_repeats_and_are_bounded(spark):
    items = [("hot", "x" * 100)] * 500 + [(f"i{i}", f"text {i} " * 10) for i in range(40)] + [("long", "y" * 5000), (None, None)]
    blocks = list(D.benchmark_blocks(spark.createDataFrame(items, ITEMS.replace("long", "string")), "item_id", "text", 1000))
    assert sorted((i or "", t) for b in blocks for i, t in b) == sorted({(i or "", t or "") for i, t in items})
    # Beyond the bound is only the part of the one text that is longer than a block.
    large = [b for b in blocks if sum(len(t) for _, t in b) > 1000]
    assert len(large) == 1 and "long" in [i for i, _ in large[0]]
    assert list(D.benchmark_blocks(spark.createDataFrame([], ITEMS), "item_id", "text", 1000)) == [[]]


def test_windows_of_equal_hash_are_told_apart():
    """Hashes patched to a few values: the words still decide, and every owner is found."""
    import numpy as np

    items = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "two three four five six seven eight nine ten eleven"), (None, "short item"), ("c", "short item"), ("d", ""), ("a", "other words altogether")]
    index = D.Index(items)
    ten = b"two three four five six seven eight nine ten eleven"
    value = textkit.gram_hash(D.Index.word_hashes(ten.split()), 10)[0]
    assert index.owners_of(10, value, ten) == {"a", "b"} and index.owners_of(10, value, ten + b"x") is None
    rows = [(np.full(2, 7, np.uint64), np.array([0, 4]), np.array([3, 7]), np.array([0, 1])), (np.full(2, 7, np.uint64), np.array([0, 4]), np.array([3, 7]), np.array([1, -1]))]
    windows = index.distinct(*(np.concatenate(x) for x in zip(*rows)))
    spelled = {index.buffer[s:e]: sorted(windows.owners[a:b].tolist()) for s, e, a, b in zip(windows.starts, windows.ends, windows.owner_at, windows.owner_at[1:])}
    assert spelled == {b"one": [0, 1], b"two": [1]}
    short = textkit.gram_hash(D.Index.word_hashes([b"short", b"item"]), 2)[0]
    assert index.owners_of(2, short, b"short item") == {"c"}
