"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import small, text_of, written

#: States: the role of the last message, or none yet.
ROLES = ("none", "system", "user", "assistant")
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = 3
#: A chunk of a conversation: the unit of work; longer conversations are chained through 4 x 4 cost matrices.
CHUNK_TURNS, FAN = 1024, 1024
BIG = 1 << 40
#: Turns of the result without their texts: two 64-bit hashes name an input row; rows alike in all columns are alike.
SAID = "conv_id long, part int, chunk int, k int, turn long, role string, action string, lead string, tail string, h long, h2 long"


@dataclass(frozen=True)
class Costs:
    """A kept turn is free. A merge joins the turn to the message before it (with another role: plus ``relabel``)."""

    merge: int = 1
    relabel: int = 2
    insert: int = 3


@dataclass(frozen=True)
class Template:
    start: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    joint: str = "\n"


@cache
def _inserts(c: Costs) -> tuple[np.ndarray, dict]:
    """Least cost from state to state by empty messages alone, and the messages."""
    cost, path = np.full((4, 4), BIG), {}
    for s in range(4):
        cost[s, s], path[s, s], front = 0, (), [s]
        while front:
            a = front.pop(0)
            for b in LEGAL[a]:
                if cost[s, a] + c.insert < cost[s, b]:
                    cost[s, b], path[s, b] = cost[s, a] + c.insert, (*path[s, a], b)
                    front.append(b)
    return cost, path


@cache
def _step(role: int, c: Costs) -> tuple[np.ndarray, dict]:
    """Least cost of one turn from state to state, and how: (action, messages inserted before).

    Role 0 is an unknown one: any label counts as a relabel. Ties go to keep, merge, relabel, in this order.
    """
    ins, path = _inserts(c)
    cost, how = np.full((4, 4), BIG), {}

    def offer(a: int, b: int, x: int, what: tuple) -> None:
        if x < cost[a, b]:
            cost[a, b], how[a, b] = x, what

    for s in range(4):
        emits = [(x, p) for p in range(4) for x in LEGAL[p]]
        for x, p in emits:
            if x == role:
                offer(s, x, ins[s, p], ("keep", path.get((s, p), ())))
        if s:
            offer(s, s, c.merge + (0 if s == role else c.relabel), ("merge", ()))
        for x, p in emits:
            if x != role:
                offer(s, x, ins[s, p] + c.relabel, ("relabel", path.get((s, p), ())))
    return cost, how


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), BIG)


def chain(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """States before, between and after a chain of cost matrices on a least-cost way from ``entry`` to ``exit_``."""
    cost = np.full(4, BIG)
    cost[entry] = 0
    back = []
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), BIG)
    states = [exit_]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def repair(roles: list[int], entry: int, exit_: int | None, c: Costs = Costs()) -> tuple[list[tuple], tuple[int, ...]]:  # noqa: B008
    """Turns' role codes -> [(role, action, inserted before)] at least cost, and messages inserted at the end.

    ``exit_`` None: the conversation ends here, in an assistant message.
    """
    ms = [_step(r, c)[0] for r in roles]
    ins, path = _inserts(c)
    states = chain([*ms, ins], entry, FINAL) if exit_ is None else chain(ms, entry, exit_)
    out = []
    for k, r in enumerate(roles):
        action, before = _step(r, c)[1][states[k], states[k + 1]]
        out.append((states[k + 1], action, before))
    return out, path[states[len(roles)], FINAL] if exit_ is None else ()


def _code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES[1:] else 0


def _chunks(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, conv = TaskContext.get().partitionId(), 0, [], None

        def close() -> pa.RecordBatch:
            m = _step(_code(held[0][1]), costs)[0]
            for x in held[1:]:
                m = _times(m, _step(_code(x[1]), costs)[0])
            cols = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int32())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            cols += [pa.array([list(x)], pa.list_(t)) for x, t in zip([*zip(*held, strict=True), m.ravel().tolist()], [*kinds, pa.int64()], strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "chunk", "turns", "roles", "h", "h2", "m"])

        for b in batches:
            for c, *turn in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "h", "h2")), strict=True):
                if held and (c != conv or len(held) >= CHUNK_TURNS):
                    yield close()
                    n, held = n + 1, []
                conv = c
                held.append(turn)
        if held:
            yield close()

    return run


def _entries(chunks: DataFrame, costs: Costs) -> DataFrame:
    """(conv_id, idx, m, entry, exit per group ``g``) solved within groups of FAN; see ``chunk_states``."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        ms = [np.array(m).reshape(4, 4) for m in pdf["m"]]
        entry, exit_ = int(pdf["g_entry"].iloc[0]), int(pdf["g_exit"].iloc[0])
        states = chain([*ms, _inserts(costs)[0]], entry, FINAL)[:-1] if exit_ < 0 else chain(ms, entry, exit_)
        last = [*states[1:-1], -1 if exit_ < 0 else states[-1]]
        return pd.DataFrame({"gid": pdf["gid"], "idx": pdf["idx"], "entry": states[:-1], "exit": last})

    return chunks.groupBy("gid", "g").applyInPandas(solve, "gid string, idx long, entry int, exit int")


def chunk_states(chunks: DataFrame, costs: Costs) -> DataFrame:
    """(gid, idx, m) of conversations with several chunks -> (gid, idx, entry, exit); exit -1 marks the last chunk.

    At most FAN matrices meet in a task: runs of FAN chunks are multiplied into one, the shorter table is solved first
    (recursively), and its states bound each run.
    """
    top = chunks.agg(F.max("idx").alias("x")).first()["x"]
    if top is None or top < FAN:
        return _entries(chunks.select("gid", "idx", "m", F.lit(0).cast("long").alias("g"), F.lit(0).alias("g_entry"), F.lit(-1).alias("g_exit")), costs)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf.sort_values("idx")["m"]:
            m = np.array(m).reshape(4, 4)
            out = m if out is None else _times(out, m)
        return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "idx": [pdf["idx"].iloc[0] // FAN], "m": [out.ravel().tolist()]})

    runs = chunks.withColumn("g", F.floor(F.col("idx") / FAN).cast("long"))
    upper = chunk_states(written(runs.groupBy("gid", "g").applyInPandas(product, "gid string, idx long, m array<long>"), "runs"), costs)
    bounds = upper.select("gid", F.col("idx").alias("g"), F.col("entry").alias("g_entry"), F.col("exit").alias("g_exit"))
    return _entries(runs.join(bounds, ["gid", "g"]), costs)


def _said(r: dict, costs: Costs, template: Template) -> list[list]:
    """Rows (SAID) of a chunk whose entry and exit states are known; the text itself goes between lead and tail."""
    rows, open_ = [], r["entry"] > 0
    done, after = repair([_code(x) for x in r["roles"]], r["entry"], None if r["exit"] < 0 else r["exit"], costs)

    def say(turn: int | None, role: int, action: str, h: int | None, h2: int | None) -> None:
        nonlocal open_
        lead = template.joint if action == "merge" else (template.end if open_ else "") + template.start.format(role=ROLES[role])
        open_ = True
        rows.append([r["conv_id"], r["part"], r["chunk"], len(rows), turn, ROLES[role], action, lead, "", h, h2])

    for turn, h, h2, (role, action, before) in zip(r["turns"], r["h"], r["h2"], done, strict=True):
        for x in before:
            say(None, x, "insert", None, None)
        say(turn, role, action, h, h2)
    for x in after:
        say(None, x, "insert", None, None)
    if r["exit"] < 0:
        rows[-1][8] = template.end
    return rows


def _decode(costs: Costs, template: Template):
    names = [f.split()[0] for f in SAID.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [x for r in b.slice(at, 256).to_pylist() for x in _said(r, costs, template)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def format_chats(turns: DataFrame, *, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:  # noqa: B008
    """Rows of the repaired conversations: conv_id, position, turn, role, action, text, rendered.

    Legal: an optional system message, then user and assistant in turn, ending with the assistant. Every input turn is
    kept, merged into the message before it, or relabelled; empty messages (turn null) are inserted. Dynamic
    programming finds a repair of least total cost; ties prefer keep, merge, relabel and the lower state. ``rendered``
    strings of a conversation, by position, join to its text, so no row grows with the conversation.

    Roles and hashes alone are range-partitioned by (conversation, turn, hash, row number), so one conversation may span any number
    of tasks; each task cuts its stretch into chunks, a chunk acts on states as a 4 x 4 min-plus matrix, and
    conversations of several chunks are chained through these (``chunk_states``) before all chunks are decoded on their
    own. The texts move once, when they join their turns by a 128-bit hash of the row.

    Turns with equal numbers are ordered by a hash of role and text; null turn numbers come first. A null or unknown
    role counts as a relabel whatever it becomes. A null text is empty, and texts of any length are one value of one
    row. Null conv_id is a conversation of its own. Rows that repeat all columns are turns of their own. Other columns
    are not read. ``conv_id`` and ``turn`` are integers. An empty table gives an empty one.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text_of().alias("text"))
    whole = ["conv_id", "turn", "role", "text"]
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in whole[:3]])  # the hash passes nulls over
    rows = rows.withColumns({"order": F.xxhash64("role", "text"), "h": F.xxhash64(missing, *whole), "h2": F.xxhash64(F.lit(1), missing, *whole)})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("order"), F.col("h"), F.col("r")]
    schema = "conv_id long, part int, chunk int, turns array<long>, roles array<string>, h array<long>, h2 array<long>, m array<long>"
    slim = written(rows.drop("text").withColumn("r", F.monotonically_increasing_id()), "turns")  # r deals rows that repeat all columns
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("order", "r")
    chunks = written(dealt.mapInArrow(_chunks(costs), schema), "chunks")

    several = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    place = W.partitionBy("gid").orderBy("part", "chunk")
    many = chunks.select("conv_id", "part", "chunk", "m").join(several, F.col("conv_id").eqNullSafe(F.col("c")))
    many = many.withColumn("gid", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    many = written(many.withColumn("idx", (F.row_number().over(place) - 1).cast("long")).drop("conv_id", "c"), "many")
    states = chunk_states(many.select("gid", "idx", "m"), costs).join(many.drop("m"), ["gid", "idx"]).select("part", "chunk", "entry", "exit")
    known = chunks.drop("m").join(small(written(states, "states")), ["part", "chunk"], "left")
    known = known.withColumns({"entry": F.coalesce("entry", F.lit(0)), "exit": F.coalesce("exit", F.lit(-1))})
    said = written(known.mapInArrow(_decode(costs, template), SAID), "said")

    spread = many.select("part", "chunk", "gid", "idx")
    counts = said.select("part", "chunk").join(small(spread), ["part", "chunk"]).groupBy("gid", "part", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", "chunk", F.coalesce(F.sum("n").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    said = said.join(small(written(base, "base")), ["part", "chunk"], "left")
    said = said.withColumn("position", (F.coalesce("base", F.lit(0)) + F.col("k")).cast("long"))
    texts = rows.select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), "text").dropDuplicates(["_h", "_h2"])
    turned = said.where("action <> 'insert'").join(texts.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2")))
    out = turned.drop("_h", "_h2").unionByName(said.where("action = 'insert'").withColumn("text", F.lit("")))
    return out.select("conv_id", "position", "turn", "role", "action", "text", F.concat("lead", "text", "tail").alias("rendered"))
