import random

import numpy as np
import pytest

from priorframe.llm import token_counts as T

SCHEMA = "doc_id long, text string, n_tokens string, title string"


def brute(text, spans, rule):
    """By walking over the tokens' bytes one by one."""
    encoding, _ = T.tokenizer(T.TOKENIZER)
    owner = [next((k for k, (a, b) in enumerate(spans) if a <= i < b), None) for i in range(len(text.encode()))]
    out, crossing, at = [0.0] * len(spans), 0, 0
    for t in encoding.encode_ordinary(text):
        own = owner[at : at + len(encoding.decode_single_token_bytes(t))]
        at += len(own)
        kinds = list(dict.fromkeys(own))
        crossing += len(kinds) > 1 and any(k is not None for k in kinds)
        if rule == "split":
            for k in kinds:
                if k is not None:
                    out[k] += own.count(k) / len(own)
            continue
        inside = [k for k in kinds if k is not None]
        if rule == "majority":
            best = max(inside, key=own.count, default=None)
            pick = best if best is not None and own.count(best) >= own.count(None) else None
        else:
            pick = own[0] if rule == "start" else own[-1]
        if pick is not None:
            out[pick] += 1
    return out, crossing


def texts():
    rng = random.Random(6)
    parts = ["The cat", " sat.", "\n", "\n\n", " \n ", "été", "\U0001f600", "<|endoftext|>", "   ", "12345", "x" * 300]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(40)] + ["", "\n", " " * 12000 + "a\n" + "\n" * 11000]


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_match_brute_force(spark, rule):
    rows = list(enumerate(texts())) + [(900, None), (900, None)]
    got = T.count_tokens(spark.createDataFrame([(i, t, "clash", "") for i, t in rows], SCHEMA), rule=rule)
    assert got.columns == ["doc_id", "text", "title", "n_tokens", "n_crossing", "section_tokens"]
    for r in got.collect():
        raw = (r.text or "").encode()
        first, past = T.line_sections(np.frombuffer(raw, np.uint8))
        assert b"".join(raw[a:b] for a, b in zip(first, past)) == raw
        if len(raw) < 10_000:
            want, crossing = brute(r.text or "", list(zip(first, past)), rule)
            assert np.allclose(r.section_tokens, want) and r.n_crossing == crossing
        if rule in ("start", "split"):
            assert abs(sum(r.section_tokens) - r.n_tokens) < 1e-6


@pytest.mark.parametrize("rule", T.RULES)
def test_fields_match_brute_force(spark, rule):
    rows = [(i, t, None, random.Random(i).choice(["A title", "", None, "T \n"])) for i, t in enumerate(texts()[:40])]
    for r in T.count_tokens(spark.createDataFrame(rows, SCHEMA), fields=("title", "text"), rule=rule).collect():
        a, b = r.title or "", r.text or ""
        n, m = len(a.encode()), len(b.encode())
        want, crossing = brute(a + "\n" + b, [(0, n), (n + 1, n + 1 + m)], rule)
        assert np.allclose(r.section_tokens, want) and r.n_crossing == crossing


def test_tokens_rebuild_the_text():
    encoding, _ = T.tokenizer(T.TOKENIZER)
    for t in texts():
        ends = T.token_ends(t)
        assert (ends[-1] if len(ends) else 0) == len(t.encode())
        if len(t) < 5000:
            assert len(ends) == len(encoding.encode_ordinary(t))


def test_query_and_empty_table(spark):
    rows = T.op3_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(sum(r.section_tokens) == r.n_tokens for r in rows)
    assert T.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_runs_are_encoded_as_in_the_whole_text():
    encoding, _ = T.tokenizer(T.TOKENIZER)
    cases = ["a" + "\u00a0" * 10_001 + "b", "a" + " " * 6_000 + "b", " " * 700, "x\n" + "\n" * 900 + "\x1c" + "\t" * 600, "a" + " " * 500 + "\u3000 b" + "\u2003" * 800]
    for text in cases:
        whole = encoding.encode_ordinary(text)
        for long_run in (1, 2, 100, 5_000):
            assert T.token_ids(text, encoding, long_run) == whole
    assert len(T.token_ids(cases[0], encoding)) == 628
    assert len(T.token_ids("a" + " " * 1_500_000 + "b", encoding)) == 1_500_001


def test_extra_columns_with_names_of_its_own(spark):
    docs = spark.createDataFrame([("a b", "f", 7)], "text string, _field0 string, c0 int")
    row = T.count_tokens(docs).first()
    assert (row["_field0"], row["c0"], row["n_tokens"]) == ("f", 7, 2)
