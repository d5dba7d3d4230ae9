"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole, so that its tokens are those a model would see.
Token bytes add up to the text, which gives each token its span; spans are joined to
the sections (spans too) by binary search. A token that crosses a boundary is
allocated by an explicit rule:

- ``start``: to the section of its first byte,
- ``end``: to that of its last byte,
- ``majority``: to that with most of its bytes (of equal ones the first),
- ``split``: to all it touches, in proportion to bytes.

Sections don't overlap and are ordered. Bytes outside all sections belong to none;
tokens allocated there count in the document only.

Standard sections are the lines, each with its line feed. With ``fields`` the columns
named are the sections of one text that joins them with line feeds.

Edge cases: null and empty texts have no tokens and no sections; a null field is an
empty section; repeated rows are counted alike and all stay; strings of special
tokens are ordinary text; very long texts are encoded whole like others, runs of any
length included; extra columns pass through, whatever their names, unless it is that
of a result column; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorframe.llm import textkit
from priorframe.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "majority", "split")
#: Fixed value: what the pattern takes as blank.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of blanks of this length are handed to the merges directly: the pattern engine's stack ends at about a million.
LONG_RUN = 100_000

RESULT = (
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_crossing", T.LongType()),
    T.StructField("section_tokens", T.ArrayType(T.DoubleType())),
)


@lru_cache(2)
def tokenizer(path: str):
    """The encoding and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ids(text: str, encoding, long_run: int = LONG_RUN) -> list[int]:
    """Tokens of the whole text, the same with any long_run.

    Of a run of blanks before another character the pattern makes one piece of all but
    the last, of a run that ends the text one of all; no piece before it reaches into it
    and none after it looks back. So the piece of a long run is merged by itself.
    """
    if len(text) < long_run:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(f"[{BLANK}]{{{long_run},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def token_ends(text: str, path: str = TOKENIZER) -> np.ndarray:
    """End of each token in bytes of the UTF-8 text."""
    encoding, lengths = tokenizer(path)
    return np.cumsum(lengths[np.array(token_ids(text, encoding), np.int64)])


def line_sections(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lines with their line feeds."""
    ends = np.flatnonzero(buf == 10) + 1
    if len(buf) and (not len(ends) or ends[-1] < len(buf)):
        ends = np.append(ends, len(buf))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


def attribute(ends: np.ndarray, first: np.ndarray, past: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [first, past), and how many tokens touch two sections, or one and bytes of none."""
    out = np.zeros(len(first))
    if not len(ends) or not len(first):
        return out, 0
    starts = np.concatenate([[0], ends[:-1]])
    section = lambda at: np.searchsorted(past, at, "right")  # noqa: E731  the one that ends behind this byte
    low, high = section(starts), section(ends - 1)
    inside = lambda s, at: (s < len(first)) & (first[np.minimum(s, len(first) - 1)] <= at)
    whole = (low == high) & inside(low, starts)
    np.add.at(out, low[whole], 1)
    crossing = 0
    for t in np.flatnonzero(~whole):
        s = np.arange(low[t], min(high[t], len(first) - 1) + 1)
        share = np.minimum(past[s], ends[t]) - np.maximum(first[s], starts[t])
        s, share = s[share > 0], share[share > 0]
        crossing += len(s) > 0
        if not len(s):
            continue
        if rule == "split":
            out[s] += share / (ends[t] - starts[t])
        elif rule == "majority":
            outside = ends[t] - starts[t] - share.sum()
            if share.max() >= outside:
                out[s[share.argmax()]] += 1
        else:
            at = starts[t] if rule == "start" else ends[t] - 1
            hit = (first[s] <= at) & (at < past[s])
            out[s[hit]] += 1
    return out, crossing


def count_tokens(docs: DataFrame, text: str = "text", rule: str = "start", fields: tuple[str, ...] = (), path: str = TOKENIZER) -> DataFrame:
    """docs with n_tokens, n_crossing and section_tokens (a count for each section)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [f.name for f in RESULT]
    source = fields or (text,)
    # Columns are told by their places, so names may repeat here.
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), *(F.col(f"`{c}`") for c in source))
    n_plain = len(plain.columns) - len(source)
    schema = T.StructType([*plain.schema.fields[:n_plain], *RESULT])
    plain = plain.toDF(*(f"c{i}" for i in range(len(plain.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, crossing, sections = [], [], []
            for row in zip(*(batch.column(n_plain + i) for i in range(len(source)))):
                parts = [x.as_py() or "" for x in row]
                whole = "\n".join(parts)
                if fields:
                    sizes = np.array([len(p.encode()) for p in parts])
                    first = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
                    past = first + sizes
                else:
                    first, past = line_sections(np.frombuffer(whole.encode(), np.uint8))
                ends = token_ends(whole, path)
                found, crossed = attribute(ends, first, past, rule)
                tokens.append(len(ends))
                crossing.append(int(crossed))
                sections.append(found)
            columns = [batch.column(i) for i in range(n_plain)] + [pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.array(sections, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return plain.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = F.transform("section_tokens", lambda x: x.cast("long"))
    return counted.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "n_crossing", counts.alias("section_tokens"))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
