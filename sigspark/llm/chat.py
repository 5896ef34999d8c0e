"""Chat formatting by minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns in alternation, beginning with user and ending with
assistant. The automaton's states are the role of the last output turn; each input turn is kept, relabelled, merged into
the output turn before it, or preceded by empty turns, at the costs below, and dynamic programming finds the cheapest way
through. Turns are joined in blocks of `BLOCK` turn numbers, and blocks with many rows to a number are cut by rank into parts of
`BLOCK` turns, so a conversation of any length and any numbers is bounded per row: a block (or part of one) is a matrix of costs between states, the matrices of a long conversation are multiplied (minimum and sum) to find the states at
its block borders, and every block is then repaired between its border states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Bloom, written

BLOCK = 512
#: a block of turn numbers with more than FULL * BLOCK rows is cut by rank
FULL = 4
#: rows behind one range of hashes of such blocks, and bits of a hash that tell the ranges at most
PART_ROWS = 1 << 14
MAX_BITS = 12
ROLES = ["system", "user", "assistant"]
#: other spellings of a role
SAME = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: costs: another label for a known role, a label for an unknown one, one merge, one empty turn
RELABEL, LABEL, MERGE, EMPTY = 4, 1, 1, 3
INF = 1 << 40

#: empty turns needed to go from a state to a turn of a role (columns system, user, assistant)
GAPS = {START: ([], [], [USER]), SYSTEM: (None, [], [USER]), USER: (None, [ASSISTANT], []), ASSISTANT: (None, [], [USER])}
#: empty turns behind the last state
CLOSE = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def role_code(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = SAME.get(r, r)
    return ROLES.index(r) + 1 if r in ROLES else 0


def _turn(code: int) -> tuple[np.ndarray, list]:
    """Cost from state to state of one input turn, and how: (label, merge, empties)."""
    cost, how = np.full((4, 4), INF, np.int64), [[None] * 4 for _ in range(4)]
    for state in range(4):
        for label in (SYSTEM, USER, ASSISTANT):
            base = 0 if code == label else LABEL if code == 0 else RELABEL
            ways = []
            if state == label:
                ways.append((base + MERGE, (label, True, [])))
            gap = GAPS[state][label - 1]
            if gap is not None and not (state == label and label == SYSTEM):
                ways.append((base + EMPTY * len(gap), (label, False, gap)))
            if ways:
                cost[state, label], how[state][label] = min(ways, key=lambda w: w[0])
    return cost, how


TURNS = [_turn(c) for c in range(4)]
END = np.array([EMPTY * len(CLOSE[s]) for s in range(4)], np.int64)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), INF)


def matrix(codes: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
    for c in codes:
        out = multiply(out, TURNS[c][0])
    return out


def repair(codes: list[int], start: int = START, end: int | None = None) -> tuple[list[tuple], int]:
    """(label, merge, empties) of every turn and the final state: the cheapest way from `start` to `end`, or to any state
    plus the empty turns that close the chat. Ties go to the smaller state."""
    best = np.full(4, INF, np.int64)
    best[start] = 0
    back = []
    for c in codes:
        total = best[:, None] + TURNS[c][0]
        back.append(total.argmin(0))
        best = np.minimum(total.min(0), INF)
    state = int((best + END).argmin()) if end is None else end
    last, out = state, []
    for c, b in zip(reversed(codes), reversed(back)):
        before = int(b[state])
        out.append(TURNS[c][1][before][state])
        state = before
    return out[::-1], last


def header(label: int) -> str:
    return f"<|{ROLES[label - 1]}|>\n"


def render(texts: list[str], plan: list[tuple], opened: bool, closing: list[int] | None) -> list[str]:
    """The piece of every turn; joined they are the chat. A merged turn follows its predecessor after a blank line."""
    out = []
    for text, (label, merge, empties) in zip(texts, plan):
        piece = "\n\n" if merge else ("<|end|>\n" if opened else "") + "".join(header(e) + "<|end|>\n" for e in empties) + header(label)
        out.append(piece + text)
        opened = True
    if closing is not None and out:
        out[-1] += "<|end|>\n" + "".join(header(e) + "<|end|>\n" for e in closing)
    return out


def blocks(conversations: DataFrame) -> DataFrame:
    """conv_id, block, part, rows (array of at, hash, turn, role, text, times in order): the turns of a block of turn
    numbers, in parts of `BLOCK` rows where the numbers hold many rows. Equal rows of a part are one entry."""
    spark = conversations.sparkSession
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    c = c.withColumn("at", at).withColumn("block", F.floor(at / BLOCK))
    sizes = c.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    # what the filter takes for full by mistake is numbered as well, whole blocks at a time
    bloom = Bloom(sizes.where(F.col("n") > FULL * BLOCK).select(F.xxhash64("conv_id", "block").alias("h")), "h")
    c = c.withColumn("h", F.xxhash64("role", "text"))
    cols = ["conv_id", "block", "part", "at", "h", "turn", "role", "text", "times"]
    whole = {"part": F.lit(0).cast("long"), "times": F.lit(1).cast("long")}
    turns = F.array_sort(F.collect_list(F.struct(*cols[3:]))).alias("rows")
    if not bloom.words.any():
        return c.withColumns(whole).groupBy("conv_id", "block", "part").agg(turns)
    words = bloom.shared(spark)

    @F.pandas_udf("boolean")
    def full(h: pd.Series) -> pd.Series:
        return pd.Series(Bloom.hits(words.value, h.to_numpy()))

    c = c.withColumn("full", full(F.xxhash64("conv_id", "block")))
    light = c.where(~F.col("full")).withColumns(whole)
    # equal rows are interchangeable: counted, they need no order among themselves, however many they are
    key = ["conv_id", "block", "at", "h"]
    same = c.where("full").groupBy(*key, "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    bits = min(MAX_BITS, max(0, (c.count() // PART_ROWS).bit_length()))
    heavy = _numbered(same.withColumn("slice", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")))
    last = F.floor((F.col("before") + F.col("times") - 1) / BLOCK)
    heavy = heavy.withColumn("part", F.explode(F.sequence(F.floor(F.col("before") / BLOCK), last)))
    times = F.least(F.col("before") + F.col("times"), (F.col("part") + 1) * BLOCK) - F.greatest(F.col("before"), F.col("part") * BLOCK)
    x = light.select(*cols).union(heavy.withColumn("times", times).select(*cols))
    return x.groupBy("conv_id", "block", "part").agg(turns)


def _numbered(rows: DataFrame) -> DataFrame:
    """`before`: how many turns of the conversation's block come before the row's by (at, h, role, text). A slice is a turn
    number and a range of hashes; slices are added up by their sizes, rows are sorted inside their slice only."""
    x = rows.withColumns({"c": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    block, piece = ["c", "none", "block"], ["c", "none", "block", "at", "slice"]
    n = x.groupBy(*piece).agg(F.sum("times").alias("_n"))
    ahead = F.sum("_n").over(W.partitionBy(*block).orderBy("at", "slice").rowsBetween(W.unboundedPreceding, -1))
    n = n.select(*piece, F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum("times").over(W.partitionBy(*piece).orderBy("h", "turn", "role", "text").rowsBetween(W.unboundedPreceding, -1))
    return x.join(n, piece).withColumn("before", F.col("_ahead") + F.coalesce(inside, F.lit(0))).drop("c", "none", "_ahead")


def _turns(rows: list[dict]) -> list[dict]:
    return [r for r in rows for _ in range(r["times"])]


def _borders(b: DataFrame) -> DataFrame:
    """start and end state of every block (or part) of conversations with several; end is null for the last one."""
    n = b.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"))
    roles = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["times"].alias("times")))
    many = b.select("conv_id", "block", "part", roles.alias("roles")).join(n, F.col("conv_id").eqNullSafe(F.col("_c")))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            m = [matrix([role_code(r["role"]) for r in _turns(roles)]).ravel().tolist() for roles in t.column("roles").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("conv_id"), t.column("block"), t.column("part"), pa.array(m, pa.list_(pa.int64()))], ["conv_id", "block", "part", "m"])

    def chain(t: pa.Table) -> pa.Table:
        # one row of 16 numbers per BLOCK turns of a conversation
        t = t.sort_by([("block", "ascending"), ("part", "ascending")])
        ms = np.array(t.column("m").to_pylist(), np.int64).reshape(-1, 4, 4)
        best, steps = np.full(4, INF, np.int64), []
        best[START] = 0
        for m in ms:
            total = best[:, None] + m
            steps.append(total.argmin(0))
            best = np.minimum(total.min(0), INF)
        state, states = int((best + END).argmin()), []
        for s in reversed(steps):
            states.append(state)
            state = int(s[state])
        states = [START, *states[::-1]]
        return pa.table([t.column("conv_id"), t.column("block"), t.column("part"), pa.array(states[:-1], pa.int32()), pa.array([*states[1:-1], None], pa.int32())],
                        ["conv_id", "block", "part", "first", "last"])

    x = many.mapInArrow(costs, "conv_id long, block long, part long, m array<long>")
    return x.groupBy("conv_id").applyInArrow(chain, "conv_id long, block long, part long, first int, last int")


def format_chats(conversations: DataFrame) -> DataFrame:
    """The repaired chat of every conversation, a row per input turn.

    Input: conv_id, turn, role, text; other columns are ignored. Output: conv_id, turn, role (as given), out_role, action
    (keep, relabel, merge, relabel and merge), n_empty (empty turns put before it), cost, n_closing (empty turns behind
    the last), piece. The pieces of a conversation in order of (block, place) are the rendered chat. Turns are
    ordered by number, null first, turns of one number by a hash of role and text; repeated rows are turns of their own.
    A null or unknown role takes the cheapest label; null text is empty; rows without conv_id are one conversation. An
    empty table gives an empty result.
    """
    b = written(blocks(conversations), "chat")
    e = _borders(b)
    x = b.join(e.withColumnsRenamed({"conv_id": "_c", "block": "_b", "part": "_p"}),
               F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("part") == F.col("_p")), "left")
    out = "conv_id long, turn long, role string, out_role string, action string, n_empty int, n_closing int, cost int, piece string, block long, place long"
    names = [c.split()[0] for c in out.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 3, pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            for conv, block, part, turns, first, last in zip(*[t.column(c).to_pylist() for c in ("conv_id", "block", "part", "rows", "first", "last")]):
                turns = _turns(turns)
                codes = [role_code(r["role"]) for r in turns]
                start = START if first is None else first
                plan, state = repair(codes, start, last)
                closing = CLOSE[state] if last is None else None
                pieces = render([r["text"] for r in turns], plan, start != START, closing)
                for i, (r, c, (label, merge, empties), p) in enumerate(zip(turns, codes, plan, pieces)):
                    base = 0 if c == label else LABEL if c == 0 else RELABEL
                    action = " and ".join(["relabel"] * (c != label) + ["merge"] * merge) or "keep"
                    behind = len(closing) if closing is not None and i == len(turns) - 1 else 0
                    rows.append((conv, r["turn"], r["role"], ROLES[label - 1], action, len(empties), behind, base + MERGE * merge + EMPTY * (len(empties) + behind), p, block, part * BLOCK + i))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return x.select("conv_id", "block", "part", "rows", "first", "last").mapInArrow(run, out)
