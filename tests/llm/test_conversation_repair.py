import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from priorframe.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def best(turns, faults):
    """(cost, audit, lines) by recursion over all edits: every state's initials are checked against the grammar."""
    opens = lambda state: {"": "u", "s": "u", "u": "a", "a": "u"}[state]

    @functools.cache
    def go(i, state, inserted):
        options = []
        if i == len(turns) and state in ("", "a"):
            options.append((0, "", ()))

        def add(cost, letter, line, j, then, n):
            c, audit, lines = go(j, then, n)
            options.append((cost + c, letter + audit, line + lines))

        role = {"u": "user", "a": "assistant"}[opens(state)]
        if inserted < 2:
            add(2, "I", (f"{role}:",), i, role[0], inserted + 1)
        if i < len(turns):
            add(3, "D", (), i + 1, state, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                own = turns[i][0][:1]
                if own == opens(state) or (own == "s" and state == ""):
                    add(more, "K", (f"{turns[i][0]}:{turns[i][1]}",), i + 1, own, 0)
                add(2 + more, "R", (f"{role}:{turns[i][1]}",), i + 1, role[0], 0)
        return min(options, default=(10**9, "", ()))

    return go(0, "", 0)


def brute(rows, originals):
    """Facts of every conversation of rows, in the order of the columns of the query."""
    out = {}
    for conv in {r[0] for r in originals}:
        own = [r for r in rows if r[0] == conv]
        digest = lambda r: hashlib.md5(f"{r}".encode()).hexdigest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], digest(r)))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.strip(BLANK)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit, lines = best([(r[2], r[3]) for r in own], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def world(n=120, seed=0, most=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(rng.integers(1, most)):
            role = str(rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]))
            rows.append((c, int(t + (rng.random() < 0.1)), role, str(rng.choice(["Yes.", "no", "", " \n", "What?", f"t{rng.integers(0, 40)}!"]))))
    return rows


def run(spark, rows):
    """conv -> facts and digest, through the operator, on rows as they are."""
    repaired, facts = C.repair(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3))
    sums = {r.conv: r.sha256 for r in C.conversation_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv: (*list(r)[1:], sums.get(r.conv, empty)) for r in facts.collect()}


def test_equals_brute_force(spark):
    rows = world()
    assert run(spark, rows) == brute(rows, rows)


def test_blocks_and_long_conversations(spark, monkeypatch):
    """A conversation that holds most rows is cut in many blocks, and nothing changes."""
    rows = world(10, 1) + [(77, i, ["user", "assistant", "system", "x"][(i * i) % 4], f"{i}." if i % 5 else "same") for i in range(150)]
    expected = brute(rows, rows)
    assert run(spark, rows) == expected
    monkeypatch.setattr(C, "BLOCK", 7)
    assert run(spark, rows) == expected


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, "user", "Hi."), (None, 3, "assistant", "Yes."), (None, None, "user", "Hi."), (1, None, "system", "s."), (1, 5, "user", "a."), (1, 5, "assistant", "b."), (1, 5, "user", "a."), (2, 0, "", "x."), (3, 1, "user", "é" * 100_000)]
    assert run(spark, rows) == brute(rows, rows)
    null = run(spark, [(1, None, None, None), (1, 0, "user", None)])
    assert null[1][:6] == (0, 2, 0, 0, 1, 6) and null[1][6] == "DD"


def test_the_query_on_damaged_turns(spark, tmp_path):
    rows = [(i % 60 if i % 17 else None, i // 60 if i % 23 else None, ["user", "assistant", None][i % 7 % 3], f"Text {i}." if i % 11 else None) for i in range(400)]
    rows += [(1000, 2, "user", "gone?")] + [(c, 0, "user", "one.") for c in range(2000, 2060)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = C.op11_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute(damage(rows), rows)


def test_the_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in C.op11_conversation_repair(spark, sf).collect()} == brute(damage(rows), rows)


def test_empty_table(spark):
    repaired, facts = C.repair(spark.createDataFrame([], SCHEMA))
    assert repaired.count() == facts.count() == 0


def test_repaired_turns_are_rows(spark):
    repaired, _ = C.repair(spark.createDataFrame([(1, 0, "assistant", "Well.", "", ""), (1, 1, "user", "So?", "", "")], SCHEMA))
    rows = [(r.role, r.text) for r in repaired.orderBy("conv", "place", "step").collect()]
    assert rows == [("user", ""), ("assistant", "Well."), ("user", "So?"), ("assistant", "")]  # IKKI costs as much as RR and comes first


@pytest.mark.parametrize("n", [1, 2, 3])
def test_matrices_hold_the_least_costs(n):
    """Each entry against all edits of all rows with up to two insertions before each."""
    for codes in itertools.product([0, 1, 2, 3, C.CUT + 1, C.MUST_GO + 2], repeat=n):
        got = C.matrices(np.array(codes), np.array([0, n]))[0]
        for state in range(4):
            costs = {state: 0}
            for code in codes:
                for _ in range(3):
                    for s, c in list(costs.items()):
                        t = C.GIVEN[s]
                        costs[t] = min(costs.get(t, 99), c + 2)
                after = {}
                for s, c in costs.items():
                    options = [(s, 3)]
                    if not code & C.MUST_GO:
                        more = 1 if code & C.CUT else 0
                        options += [(C.KEPT[code & 3][s], more), (C.GIVEN[s], 2 + more)]
                    for t, cost in options:
                        if t != C.NONE:
                            after[t] = min(after.get(t, 99), c + cost)
                costs = after
            assert [min(x, C.INF) for x in got[state]] == [costs.get(t, C.INF) for t in range(4)]


def test_ranks_follow_the_least_strings():
    """Paths of ranked arcs against the least of all strings of a random graph without cycles."""
    rng = np.random.default_rng(5)
    n = 40
    target = np.full((n, 4), -1)
    for v in range(n - 1):
        for letter in rng.choice(4, rng.integers(1, 4), replace=False):
            target[v, letter] = rng.integers(v + 1, n)

    @functools.cache
    def least(v):
        return min((C.LETTERS[i] + least(int(t)) for i, t in enumerate(target[v]) if t >= 0), default="")

    paths = C.least_paths(target, np.arange(n))
    assert ["".join(C.LETTERS[i] for i in letters) for letters, _ in paths] == [least(v) for v in range(n)]
    assert all(nodes[-1] == n - 1 for _, nodes in paths)
