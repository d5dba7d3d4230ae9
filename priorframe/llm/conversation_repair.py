"""Conversation repair: least-cost edits to a legal order of roles, the least audit by prefix doubling.

A legal conversation is empty, or an optional system turn and then one or more pairs of
user and assistant. Each turn is kept (cost 0), given the role user or assistant (R, 2)
or deleted (D, 3; blank and repeated turns must be), turns without text are inserted
anywhere (I, 2), and a truncated turn that stays costs 1 more. The audit is the string
of edits; of all cheapest ones the least in ASCII is taken.

A conversation is worked through in blocks of at most ``BLOCK`` turns, so that one that
holds a third of all rows is many tasks:

1. rows are dealt by ranges of (conversation, turn, role, start of the text, digest) and
   numbered; a turn's fault needs the first place of its role and text, an aggregate;
2. a block becomes a 4 x 4 matrix of least costs between states of the grammar
   (nothing yet, after system, after user, after assistant);
3. a conversation's matrices are multiplied from its end, in one stream, which gives the
   cost of what follows each block;
4. with that, each block has its cost DP and its optimal arcs. Arcs are ranked by their
   first letter, then by two, four, eight letters: the rank of twice the length is that
   of the pair (rank of the arc, least rank where its pointer ends), and pointers double
   with it. As an edit leads from a node to one node only, the arc of the least rank is
   the next step of the least path, and the doubled pointers give its every step;
5. one stream of blocks a conversation picks the state in which each is entered.

Streams hold one small state; only block rows (a byte a turn) and, for the digest of a
conversation, which has to follow the order of its text, lines go through them.

Edge cases: a null conversation is one conversation; null turns come first; null roles
and texts are empty; turns of the same number are ordered by role, the first 64
characters and a digest of the text; repeated rows are faults (duplicates), the first
stays; a role counts by its first letter; texts of any length are whole, one at a time;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from priorframe.llm.common import materialize, table

BLOCK = 4096
INF = 1 << 40
#: Letters in the order of ASCII.
DELETE, INSERT, KEEP, RENAME = range(4)
LETTERS = "DIKR"
COST_DELETE, COST_INSERT, COST_RENAME, COST_CUT = 3, 2, 2, 1
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant (4: none).
NONE = 4
ROLE_OF_STATE = (None, None, "user", "assistant")
#: Where a turn of class (system, user, assistant, other) leads from each state.
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: Where an inserted or renamed turn leads: only one of both roles is legal.
GIVEN = np.array([2, 2, 3, 2])
MUST_GO, CUT = 4, 8


def relaxed(costs: np.ndarray) -> np.ndarray:
    """Costs (n, 4, ...) of states with insertions before going on; two insertions are the most that help."""
    for _ in range(3):
        costs = np.minimum(costs, costs[:, GIVEN] + COST_INSERT)
    return costs


#: Cost of each state at the end of a conversation.
AT_END = relaxed(np.array([[0, INF, INF, 0]]))[0]


def costs_to_go(codes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least cost from each place and state of all blocks (places x 4 x m) to m goals; after (blocks x 4 x m) is that at the block's end.

    Block b has the rows first[b] .. first[b + 1] - 1 and one place more than rows, the place of row r being r + b.
    """
    sizes = np.diff(first)
    out = np.full((len(codes) + len(sizes), 4, after.shape[2]), INF)
    out[first[1:] + np.arange(len(sizes))] = after
    order = np.argsort(-sizes, kind="stable")
    long = -sizes[order]
    for t in range(int(sizes.max(initial=0)) - 1, -1, -1):
        blocks = order[: np.searchsorted(long, -t)]  # all that have a row t, in step
        row = first[blocks] + t
        here = row + blocks
        then = np.concatenate([out[here + 1], np.full((len(here), 1, out.shape[2]), INF)], axis=1)
        code = codes[row]
        stay = np.where(code & MUST_GO, INF, np.where(code & CUT, COST_CUT, 0))[:, None, None]
        keep = np.take_along_axis(then, KEPT[code & 3][:, :, None], axis=1) + stay
        best = np.minimum(np.minimum(keep, then[:, GIVEN] + stay + COST_RENAME), then[:, :4] + COST_DELETE)
        out[here] = np.minimum(relaxed(best), INF)
    return out


def matrices(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least costs of each block between its first and last state (blocks x 4 x 4)."""
    goals = np.where(np.eye(4, dtype=bool), 0, INF)
    places = first[:-1] + np.arange(len(first) - 1)
    return costs_to_go(codes, first, np.broadcast_to(goals, (len(first) - 1, 4, 4)))[places]


def optimal_arcs(codes: np.ndarray, first: np.ndarray, after: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target node of each node and letter, or -1; cost of each node); the node of place p and state q is 4 p + q.

    ends: blocks that end a conversation, where turns can still be inserted.
    """
    cost = costs_to_go(codes, first, after[:, :, None])[:, :, 0]
    target = np.full((len(cost), 4, 4), -1)
    blocks = np.repeat(np.arange(len(first) - 1), np.diff(first))
    here = np.arange(len(codes)) + blocks
    now, then = cost[here], np.concatenate([cost[here + 1], np.full((len(here), 1), INF)], axis=1)
    state = np.arange(4)
    must_go, cut = (codes & MUST_GO > 0)[:, None], np.where(codes & CUT, COST_CUT, 0)[:, None]
    to, below = KEPT[codes & 3], 4 * (here + 1)[:, None]

    def put(places: np.ndarray, letter: int, fits: np.ndarray, where: np.ndarray) -> None:
        target[places, :, letter] = np.where(fits & (cost[places] < INF), where, -1)

    put(here, DELETE, then[:, :4] + COST_DELETE == now, below + state)
    put(here, KEEP, ~must_go & (np.take_along_axis(then, to, axis=1) + cut == now), below + to)
    put(here, RENAME, ~must_go & (then[:, GIVEN] + cut + COST_RENAME == now), below + GIVEN)
    open_ = np.concatenate([here, (first[1:] + np.arange(len(ends)))[ends]])
    put(open_, INSERT, cost[open_][:, GIVEN] + COST_INSERT == cost[open_], 4 * open_[:, None] + GIVEN)
    return target.reshape(-1, 4), cost


def least_paths(target: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Letters and nodes (the last one included) of the least path from each start.

    Ranks of arcs by their least first 1, 2, 4, ... letters; jumps[k] leads 2**k letters on from a node.
    """
    n = len(target)
    last = (target < 0).all(axis=1)
    none = np.iinfo(np.int64).max
    arc = np.flatnonzero(target.ravel() >= 0)
    rank = np.full(n * 4, none)
    rank[arc] = arc % 4 + 1
    pointer = target.ravel().copy()
    jumps: list[np.ndarray] = []
    while True:
        by_node = rank.reshape(n, 4)
        best, least = by_node.argmin(axis=1), by_node.min(axis=1)
        least[last] = 0  # a path that ends comes before all that go on
        jump = np.where(last, np.arange(n), pointer[np.arange(n) * 4 + best])
        jumps.append(jump)
        if last[jump].all():
            break
        pair = rank[arc] * np.int64(len(arc) + 5) + least[pointer[arc]]
        pointer[arc] = jump[pointer[arc]]
        rank[arc] = np.unique(pair, return_inverse=True)[1] + 1
    at, length = starts.copy(), np.zeros(len(starts), np.int64)
    for k in range(len(jumps) - 1, -1, -1):
        go = ~last[jumps[k][at]]
        length[go] += 1 << k
        at = np.where(go, jumps[k][at], at)
    length += ~last[starts]
    step = np.concatenate([np.arange(m + 1) for m in length]) if len(length) else np.zeros(0, np.int64)
    node = np.repeat(starts, length + 1)
    for k, jump in enumerate(jumps):
        node = np.where(step >> k & 1, jump[node], node)
    cuts = np.cumsum(length + 1)[:-1]
    return [(best[x[:-1]], x) for x in np.split(node, cuts)] if len(length) else []


def blocks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all blocks of a batch and each block's first row (n + 1)."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    return np.asarray(column.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def with_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("costs", pa.array(list(matrices(*blocks_of(batch.column("codes"))).reshape(-1, 16)), pa.list_(pa.int64())))


def with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each state in which it can be entered: audit, state left in, cost of all that follows."""
    for batch in batches:
        codes, first = blocks_of(batch.column("codes"))
        after = np.asarray(batch.column("after").flatten()).reshape(-1, 4)
        target, cost = optimal_arcs(codes, first, after, np.asarray(batch.column("ends").to_numpy(zero_copy_only=False), bool))
        entry = first[:-1] + np.arange(len(first) - 1)
        paths = least_paths(target, (4 * entry[:, None] + np.arange(4)).ravel())
        audits = ["".join(LETTERS[i] for i in letters) for letters, _ in paths]
        left = [int(nodes[-1] % 4) for _, nodes in paths]
        by_four = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
        columns = [batch.column("conv"), batch.column("at"), batch.column("codes"), pa.array(by_four(audits), pa.list_(pa.string())), pa.array(by_four(left), pa.list_(pa.int32())), pa.array(list(cost[entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "at", "codes", "audits", "left", "costs"])


def from_the_end(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation, last one first: each gets the costs of what follows it."""
    known, after = None, None
    for row in rows:
        ends = after is None or row["conv"] != known
        known, after = row["conv"], AT_END if ends else after
        yield {"conv": known, "at": row["at"], "codes": row["codes"], "after": after.tolist(), "ends": ends}
        after = np.minimum((np.array(row["costs"]).reshape(4, 4) + after).min(axis=1), INF)


LEGAL = {(0, 1), (1, 2), (2, 1)}


def from_the_start(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation in order: each is entered in the state that the one before left."""
    known, state, role = None, None, None
    for row in rows:
        begins = state is None or row["conv"] != known
        if begins:
            known, state, role = row["conv"], 0, None
        classes = [c & 3 for c in row["codes"]]
        pairs = list(zip(classes if role is None else [role, *classes], classes[1:] if role is None else classes))
        audit = row["audits"][state]
        cost = row["costs"][state] if begins else 0
        yield {"conv": known, "at": row["at"], "audit": audit, "cost": cost, "illegal": sum(p not in LEGAL for p in pairs), "edits": edits(audit, classes, state)}
        state, role = row["left"][state], classes[-1]


def edits(audit: str, classes: list[int], state: int) -> list[dict]:
    """An audit by turns: roles inserted before the turn, its edit and new role, roles inserted after the last turn."""
    out, before = [], []
    for letter in audit:
        role = None
        if letter in "IR":
            state = int(GIVEN[state])
            role = ROLE_OF_STATE[state]
        if letter == "I":
            before.append(role)
            continue
        if letter == "K":
            state = int(KEPT[classes[len(out)]][state])
        out.append({"before": before, "edit": letter, "role": role, "after": []})
        before = []
    if before:
        out[-1]["after"] = before
    return out


def digests(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of the lines of each conversation, joined by newlines, one line at a time."""
    known, sum_ = None, None
    for row in rows:
        if sum_ is None or row["conv"] != known:
            if sum_ is not None:
                yield {"conv": known, "sha256": sum_.hexdigest()}
            known, sum_ = row["conv"], hashlib.sha256()
        else:
            sum_.update(b"\n")
        sum_.update(row["line"].encode())
    if sum_ is not None:
        yield {"conv": known, "sha256": sum_.hexdigest()}


def streamed(df: DataFrame, order: list[Column], step: Callable[[Iterator[dict]], Iterator[dict]], conv: T.DataType, rest: str) -> DataFrame:
    """step over the rows of each conversation in the order given; it holds one row and what it remembers."""
    schema = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(rest).fields])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in step(row for batch in batches for row in batch.to_pylist()):
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, kind)

    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)


def placed_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, digest (of all but the turn), and place: a number in the order of conversations and turns."""
    plain = turns.select(
        F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    plain = plain.withColumn("digest", F.md5(F.to_json(F.struct("conv", "role", "text"))))
    # Rows that are equal in all else are told apart by where they stand, so that they can be dealt to many tasks.
    plain = plain.select("*", F.substring("text", 1, 64).alias("start"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("digest"), F.col("tie")]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).drop("start", "tie")
    return materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "turns")


def with_faults(placed: DataFrame) -> DataFrame:
    """conv, turn, place, class of the role, and the turn's first fault: blank, duplicate, truncated or none."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    initial = F.substring("role", 1, 1)
    repeated = placed.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = placed.select(
        "conv", "turn", "place", "digest", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("class"),
        (F.rtrim("text", blanks) == "").alias("blank"), (~F.right(F.rtrim("text", blanks), F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ).join(repeated, "digest", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return rows.select("conv", "turn", "place", "class", fault.alias("fault"))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(repaired turns, facts): conv, place, step, role, text in order, and one row a conversation.

    Facts are gaps, blank, duplicate, truncated, illegal, cost and audit, of the turns as they came.
    """
    kind = turns.schema[conv_id].dataType
    placed = placed_turns(turns, conv_id, turn, role, text)
    rows = materialize(with_faults(placed), "faults")
    code = F.col("class") + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT).otherwise(0)
    # Places of a conversation follow each other within a part of the sort (its number is above bit 33).
    part, cut = F.shiftright("place", 33), F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / BLOCK)
    blocks = rows.groupBy("conv", part.alias("part"), cut.alias("cut")).agg(F.sort_array(F.collect_list(F.struct("place", code.cast("tinyint").alias("code")))).alias("rows"))
    blocks = blocks.select("conv", F.col("rows")[0]["place"].alias("at"), F.col("rows.code").alias("codes"))
    head = T.StructType([T.StructField("conv", kind), T.StructField("at", T.LongType()), T.StructField("codes", T.ArrayType(T.ByteType()))])
    costed = blocks.mapInArrow(with_matrices, T.StructType([*head.fields, T.StructField("costs", T.ArrayType(T.LongType()))]))
    ended = streamed(costed, [F.desc("at")], from_the_end, kind, "at long, codes array<tinyint>, after array<long>, ends boolean")
    paths = T.StructType([*head.fields, *T.StructType.fromDDL("audits array<string>, left array<int>, costs array<long>").fields])
    ranked = ended.repartition("at").mapInArrow(with_paths, paths)
    solved = streamed(ranked, [F.col("at")], from_the_start, kind, "at long, audit string, cost long, illegal long, edits array<struct<before:array<string>,edit:string,role:string,after:array<string>>>")
    solved = materialize(solved, "audits")

    by_turn = rows.groupBy("conv", "turn").agg(*(F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")))
    pieces = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("at", "audit"))).alias("a"))
    facts = counts.alias("c").join(pieces.withColumnRenamed("conv", "same").alias("p"), F.col("conv").eqNullSafe(F.col("same")))
    facts = facts.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("a.audit", "").alias("audit"))

    one = solved.select("at", F.posexplode("edits").alias("i", "e")).select((F.col("at") + F.col("i")).alias("place"), "e.*")
    given = lambda roles: F.transform(roles, lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))
    kept = one.withColumnRenamed("role", "new").join(placed.select("conv", "place", "role", "text"), "place")
    own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("new", "role").alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    out = kept.select("conv", "place", F.posexplode(F.concat(given("before"), own, given("after"))).alias("step", "t"))
    return out.select("conv", "place", "step", "t.role", "t.text"), facts


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv, sha256 of its lines role:text."""
    lines = repaired.select("conv", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return streamed(lines, [F.col("place"), F.col("step")], digests, repaired.schema["conv"].dataType, "sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which the checksum of conversation and number drops, empties, cuts, repeats or renames some."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    kept = turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired, facts = repair(damaged(turns))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One row of each kind a conversation: all are in the first, some in the others.
    names = turns.select("conv_id").distinct()
    sums = conversation_digests(repaired).select(F.col("conv").alias("conv_id"), "sha256")
    rows = names.unionByName(facts.withColumnRenamed("conv", "conv_id"), True).unionByName(sums, True)
    out = rows.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL: dict[str, str] = {}
