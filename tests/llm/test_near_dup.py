import random
import re
from collections import Counter, defaultdict

import numpy as np

from priorframe.llm import linking, near_dup as N

SCHEMA = "doc_id long, text string, node string, label long"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Least id of the class of each row, by comparing all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets, index, same = [grams(t) for _, t in rows], defaultdict(list), {}
    for i, (_, t) in enumerate(rows):
        parent[root(i)] = root(same.setdefault(t or "", i))
        for g in sets[i]:
            index[g].append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        common = sum((sets[a] & sets[b]).values())
        if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common) - 1e-9:
            parent[root(a)] = root(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted((str(d), str(least[root(i)]), len(ids[root(i)])) for i, (d, _) in enumerate(rows))


def fixture():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 30, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "a b"), (9004, "a  b"), (9005, "a b"), (9005, "a b"), (None, rows[0][1]), (9100, "x y z " * 3000), (9101, "x y z " * 2900)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def found(df):
    return sorted((str(r.doc_id), str(r.class_id), r.class_docs) for r in df.collect())


def test_fixture_matches_brute_force(spark):
    rows = fixture()
    out = N.label_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "node", "label", "class_id", "class_docs"]
    assert found(out) == brute_classes(rows)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(N.op9_near_duplicates(spark, "/root/testdata/sf0.01")) == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    rows = fixture()
    kept = N.keep_one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "label"]
    classes = {c for _, c, _ in brute_classes(rows)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(classes)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        words = [f"w{i}" for i in rng.integers(0, 400, 300)]
        y = words[: int(len(words) * (2 * share / (1 + share)))]
        y += [f"v{i}" for i in range(len(words) - len(y))]
        texts = [" ".join(words), " ".join(y)]
        raw = [t.encode() for t in texts]
        hashes, owners = N.shingles_of(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
        signs, _ = N.dart_signatures(hashes, owners, 2, 2000)
        x, y = grams(texts[0]), grams(texts[1])
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs((signs[0] == signs[1]).mean() - want) < 0.05


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**9), 200)
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[100], ids[i]) for i in range(101, 150)] + [(ids[160], ids[160])]
    got = {r.node: r.label for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    path, star = min(ids[:61]), min(ids[100:150])
    assert got == {i: path for i in ids[:61] if i != path} | {i: star for i in ids[100:150] if i != star}


def test_empty_table(spark):
    assert N.label_documents(frame(spark, [])).collect() == []
    assert N.keep_one_of_each(frame(spark, [])).collect() == []
