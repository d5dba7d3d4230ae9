import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from priorframe.llm import line_dedup as L
from priorframe.llm import linking

SCHEMA = "doc_id long, text string, node long, n_chars long"


def shingles(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return {low[i : i + 8] for i in range(len(low) - 7)} or {low}


def brute(rows):
    """Removed line numbers of each (id, text), by all pairs of lines that share a shingle."""
    seen, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, t in dict.fromkeys(rows):
        for k, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                seen[(i is None, i or 0, t, k)] = line
    for line in set(seen.values()):
        parent[line] = line
    sets = {line: shingles(line) for line in parent}
    for line, s in sets.items():
        for g in s:
            index[g].append(line)
    for a, b in {(a, b) for v in index.values() for a in v for b in v if a < b}:
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for place, line in seen.items():
        groups[root(line)].append(place)
    gone = defaultdict(list)
    for places in groups.values():
        for p in sorted(places)[1:]:
            gone[(None if p[0] else p[1], p[2])].append(p[3])
    return {k: sorted(v) for k, v in gone.items()}


def fixture():
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    pool = [line(rng.choice([3, 12, 60, 150])) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            x = rng.choice(pool) if rng.random() < 0.5 else line(rng.randint(0, 80))
            if rng.random() < 0.3 and len(x) > 50:
                at = rng.randrange(len(x))
                x = x[:at] + "X" + x[at + 1 :]
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    return rows + [(900, None), (901, ""), (902, "\n\n \n"), (903, "solo line\nsolo line\n\n"), (904, "SOLO line"), (904, "SOLO line"), (None, pool[0] + "\n" + "new words here"), (905, "\n".join(["x" * 40] * 500))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, None if t is None else len(t)) for i, t in rows], SCHEMA)


def agreement(spark, rows, docs):
    keys = {r.doc: (r.doc_id, r.text) for r in docs.select("doc_id", "text", L.doc_key("doc_id", "text").alias("doc")).collect()}
    got = {keys[r.doc]: list(r.removed) for r in L.duplicate_lines(docs).collect()}
    return got, brute(rows)


def test_copies_and_fuzzy_lines_match_brute_force(spark):
    rows = fixture()
    got, want = agreement(spark, rows, frame(spark, rows))
    assert got == want


def test_hot_buckets_match_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    boilerplate, rows = text(150), []
    for i in range(150):
        own = text(22)
        # Alike by 0.75 to all others, and by 0.8 to 0.9 to the next.
        rows += [(2 * i, boilerplate + own), (2 * i + 1, boilerplate + own[:12] + text(10) if i % 3 else boilerplate + text(22))]
    got, want = agreement(spark, rows, frame(spark, rows))
    assert len(want) >= 90
    assert got == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, want = agreement(spark, rows, docs)
    n = sum(map(len, want.values()))
    both = sum(len(set(v) & set(got.get(k, []))) for k, v in want.items())
    assert both >= 0.97 * n and sum(map(len, got.values())) <= n


def test_texts_without_duplicates(spark):
    rows = [(1, "keep this line of text\nshared line of words here\n\ntail one"), (2, "shared line of words here"), (3, "shared line of words here\nown words in three"), (4, None), (5, "")]
    out = L.drop_duplicate_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "node", "n_chars"]
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: ("own words in three", 18), 4: (None, None), 5: ("", 0)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (30, 300):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: n * 4 // 5], rng.integers(0, 2**63, n // 5).astype(np.uint64)])
        hashes, of = np.concatenate([x, y]), np.repeat([0, 1], n)
        sign = L.signatures(hashes, of, 2, 2048)
        assert abs((sign[0] == sign[1]).mean() - 4 / 6) < 0.12


def test_empty_table(spark):
    assert L.duplicate_lines(frame(spark, [])).collect() == []
    assert L.drop_duplicate_lines(frame(spark, [])).collect() == []


def test_parity_takes_a_word_a_column_not_a_number_a_bit():
    rng = np.random.default_rng(1)
    n = 40_000
    element, owner = rng.integers(0, 1 << 63, 400_000).astype(np.uint64) * np.uint64(2), rng.integers(0, n - 1, 400_000)
    tracemalloc.start()
    got = linking.parity(element, owner, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # a number for each bit would be 164 MB
    assert got.shape == (len(linking.PARITY), n) and not got[:, n - 1].any()
    for k in rng.integers(0, n, 50):
        want = [0] * len(linking.PARITY)
        for e in element[owner == k]:
            bit = (int(e) >> 40) % 512
            want[bit // 64] ^= 1 << bit % 64
        assert [int(w) for w in got[:, k].view(np.uint64)] == want


@pytest.mark.parametrize("all_meet", [linking.ALL_MEET, 1])
def test_members_of_small_buckets_meet_without_prefixes(spark, monkeypatch, all_meet):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    boilerplate, rows = text(150), []
    for i in range(50):
        own = text(22)
        rows += [(2 * i, boilerplate + own), (2 * i + 1, boilerplate + own[:12] + text(10) if i % 3 else boilerplate + text(22))]
    prefixes, made = linking.prefixes, []
    monkeypatch.setattr(linking, "ALL_MEET", all_meet)
    monkeypatch.setattr(linking, "prefixes", lambda *a: made.append(1) or prefixes(*a))
    got, want = agreement(spark, rows, frame(spark, rows))
    assert len(want) >= 30 and got == want
    # A larger bucket goes by prefixes, with the same result.
    assert bool(made) == (all_meet == 1)
