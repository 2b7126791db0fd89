"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns that alternate, from a user turn
to an assistant turn. Every source turn may be kept, relabelled, or merged into the turn before it, and empty user
or assistant turns may be inserted; each costs a whole number. The states are what was written last: nothing,
system, user, assistant. Reading a source turn is a 4 x 4 matrix of least costs, and these matrices multiply by
(min, +); so a long conversation is cut into parts that are summed up, chained and traced back apart from each
other. Only its matrices, a quarter of a byte a turn, meet in one task, and in the end its text, which is one row.

Turns are sorted by ranges of (conversation, turn, role, text), which deals a long conversation over tasks, and cut
into parts where a task's rows end or ``part`` turns are full.

Of several ways of least cost the one is taken whose first turns come first in this order: the cheaper step; keep,
merge, relabel; fewer insertions; the order of states. So results do not depend on the parts.

Defined results: turns are read in order of (turn, role, text), NULL first; repeated rows are turns like any
other; a NULL or unknown role costs a relabel whatever it becomes, and cannot stay; NULL text is empty; rows
with a NULL conv_id are one conversation of their own; ids are never changed, whatever their type; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Store, lean, small

STATES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
BIG = 1 << 40


@dataclass(frozen=True)
class Params:
    """Costs; ``part``: source turns of one part at most."""

    merge: int = 2
    relabel: int = 3
    insert: int = 5
    part: int = 512
    open_tag: str = "<|"
    close_tag: str = "|>"
    end: str = "<|end|>"


# what may follow what: system only at the start, user after start, system or assistant, assistant after user
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}


def insertions(p: Params) -> dict[tuple[int, int], tuple[int, tuple[int, ...]]]:
    """The cheapest empty turns that lead from a state to a role's turn: (cost, inserted roles)."""
    out = {}
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            if (s, r) in FOLLOWS:
                out[s, r] = (0, ())
            elif r != SYSTEM:
                between = USER if r == ASSISTANT else ASSISTANT
                if (s, between) in FOLLOWS:
                    out[s, r] = (p.insert, (between,))
    return out


class Machine:
    """Least-cost steps of the automaton for one source turn."""

    def __init__(self, p: Params):
        self.p = p
        ins = insertions(p)
        self.steps: dict[int, list[tuple[int, int, int, str, int, tuple[int, ...]]]] = {}
        for role in range(4):  # START stands for an unknown role
            found = []
            for s in range(4):
                # merging adds the text to the turn written last; a turn of another role is relabelled by that
                if s != START:
                    found.append((s, s, p.merge + (0 if role == s else p.relabel), "merge", s, ()))
                for r in (SYSTEM, USER, ASSISTANT):
                    if (s, r) in ins:
                        c, between = ins[s, r]
                        found.append((s, r, c + (0 if role == r else p.relabel), "keep" if role == r else "relabel", r, between))
            order = {"keep": 0, "merge": 1, "relabel": 2}
            found.sort(key=lambda x: (x[2], order[x[3]], len(x[5]), x[4]))
            best: dict[tuple[int, int], tuple] = {}
            for x in found:
                best.setdefault((x[0], x[1]), x)
            self.steps[role] = list(best.values())
        # a conversation ends after an assistant turn
        self.close = {START: (0, ()), ASSISTANT: (0, ()), USER: (p.insert, (ASSISTANT,)), SYSTEM: (2 * p.insert, (USER, ASSISTANT))}

    def matrix(self, roles: list[int]) -> np.ndarray:
        """Least cost from each state to each state over these turns."""
        m = np.full((4, 4), BIG, np.int64)
        np.fill_diagonal(m, 0)
        for r in roles:
            n = np.full((4, 4), BIG, np.int64)
            for s, t, c, *_ in self.steps[r]:
                np.minimum(n[:, t], m[:, s] + c, out=n[:, t])
            m = n
        return m

    def follow(self, roles: list[int], enter: int, togo: list[int]) -> list[tuple]:
        """The steps of a least-cost way from ``enter``, where ``togo`` is what each state costs after these turns. At each
        turn the first step that lies on such a way is taken, so the way hangs on nothing but the conversation."""
        value = [togo]
        for r in reversed(roles):
            v, now = value[-1], [BIG] * 4
            for s, t, c, *_ in self.steps[r]:
                if c + v[t] < now[s]:
                    now[s] = c + v[t]
            value.append(now)
        value.reverse()
        at, out = enter, []
        for k, r in enumerate(roles):
            v, left = value[k + 1], value[k][at]
            x = next(x for x in self.steps[r] if x[0] == at and x[2] + v[x[1]] == left)
            out.append(x)
            at = x[1]
        return out


ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def with_id(kind: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(rest).fields])


def parts_of(turns: DataFrame, machine: Machine, p: Params, store: Store) -> DataFrame:
    """conv_id, key, task, chunk, m, t: the turns of each part in order and their matrix; parts order by (task, chunk)."""
    role = F.lower(F.trim(F.col("role")))
    code = F.lit(START)
    for name, c in ROLES.items():
        code = F.when(role == name, c).otherwise(code)
    # the key tells conversations apart where NULL is a value like any other
    x = turns.select("conv_id", F.to_json(F.struct("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), code.alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    # ranges go by the first letters of a text, so that what is sampled for them stays small
    x = x.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("key", "turn", "role", "text")
    kind = x.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        now, chunk = None, -1
        codes: list[int] = []
        texts: list[pa.Array] = []
        ident = None

        def part() -> pa.RecordBatch:
            t = pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.concat_arrays(texts)], names=["r", "text"])
            return pa.RecordBatch.from_arrays(
                [ident, pa.array([now]), pa.array([task], pa.int32()), pa.array([chunk], pa.int32()), pa.array([machine.matrix(codes).ravel().tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), t)],
                names=["conv_id", "key", "task", "chunk", "m", "t"],
            )

        for b in batches:
            out = []
            keys, rs, text = b.column("key").to_pylist(), b.column("r").to_pylist(), b.column("text").cast(pa.string())
            i = 0
            while i < len(b):
                if keys[i] != now or len(codes) >= p.part:
                    if codes:
                        out.append(part())
                    chunk = chunk + 1 if keys[i] == now else 0
                    now, codes, texts, ident = keys[i], [], [], b.column("conv_id").slice(i, 1)
                j = i + 1
                while j < len(b) and keys[j] == now and len(codes) + j - i < p.part:
                    j += 1
                codes += rs[i:j]
                texts.append(text.slice(i, j - i))
                i = j
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if codes:
            yield part()

    schema = with_id(kind, "key string, task int, chunk int, m array<long>, t array<struct<r: int, text: string>>")
    return store.save(x.select("conv_id", "key", "r", "text").mapInArrow(lean(run), schema), "parts")


def chained(parts: DataFrame, machine: Machine, store: Store) -> DataFrame:
    """key, task, chunk, enter, togo, last: the state before each part of a conversation of several and the costs after it."""
    close = np.array([machine.close[s][0] for s in range(4)], np.int64)

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "chunk"]).reset_index(drop=True)
        v, togo = close, [close.tolist()] * len(pdf)
        for k in range(len(pdf) - 1, 0, -1):
            v = (np.array(pdf["m"][k], np.int64).reshape(4, 4) + v).min(axis=1)
            togo[k - 1] = v.tolist()
        return pdf[["key", "task", "chunk"]].assign(togo=togo, last=[k == len(pdf) - 1 for k in range(len(pdf))])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rs, togo in zip(b.column("rs").to_pylist(), b.column("togo").to_pylist(), strict=True):
                out.append([machine.follow(rs, s, togo)[-1][1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "task", "chunk", "togo", "last")), pa.array(out, pa.list_(pa.int32()))], names=["key", "task", "chunk", "togo", "last", "to"])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "chunk"]).reset_index(drop=True)
        at, out = START, []
        for to in pdf["to"]:
            out.append(at)
            at = int(to[at])
        return pdf[["key", "task", "chunk", "togo", "last"]].assign(enter=out)

    costs = parts.select("key", "task", "chunk", "m").groupBy("key").applyInPandas(back, "key string, task int, chunk int, togo array<long>, last boolean")
    roles = parts.select("key", "task", "chunk", F.col("t.r").alias("rs")).join(store.save(costs, "costs"), ["key", "task", "chunk"])
    ways = store.save(roles.mapInArrow(lean(through), "key string, task int, chunk int, togo array<long>, last boolean, to array<int>"), "ways")
    return ways.groupBy("key").applyInPandas(enter, "key string, task int, chunk int, togo array<long>, last boolean, enter int")


def rendered(parts: DataFrame, machine: Machine, p: Params) -> DataFrame:
    """conv_id, key, task, chunk, n_in, n_out, cost, merged, relabelled, inserted, rendered of each part. A part without a
    state before it (``enter`` is NULL) is a whole conversation."""
    head = lambda r: f"{p.open_tag}{STATES[r]}{p.close_tag}\n"
    numbers = ("n_in", "n_out", "cost", "merged", "relabelled", "inserted")

    def one(codes: list[int], texts: list[str], enter: int, togo: list[int], last: bool) -> tuple[tuple[int, ...], str]:
        buf: list[str] = []
        is_open = enter != START
        n_out = cost = merged = relabelled = inserted = 0
        steps = machine.follow(codes, enter, togo)
        for r0, text, (_, _, c, what, r, between) in zip(codes, texts, steps, strict=True):
            cost += c
            if what == "merge":
                merged += 1
                relabelled += r0 != r
                buf.append("\n" + text)
                continue
            for b in (*between, r):
                if is_open:
                    buf.append(f"{p.end}\n")
                buf.append(head(b))
                is_open = True
                n_out += 1
            inserted += len(between)
            relabelled += what == "relabel"
            buf.append(text)
        if last:
            c, ends = machine.close[steps[-1][1]]
            cost += c
            for b in ends:
                buf.append(f"{p.end}\n" + head(b))
                n_out += 1
                inserted += 1
            buf.append(f"{p.end}\n")
        return (len(codes), n_out, cost, merged, relabelled, inserted), "".join(buf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = [machine.close[s][0] for s in range(4)]
        for b in batches:
            rows, texts = [], []
            enters, togos, lasts = (b.column(c).to_pylist() for c in ("enter", "togo", "last"))
            for k in range(len(b)):
                t = b.column("t")[k].values
                codes, text = t.field("r").to_pylist(), t.field("text").to_pylist()
                row, whole = one(codes, text, START, close, True) if enters[k] is None else one(codes, text, enters[k], togos[k], lasts[k])
                rows.append(row)
                texts.append(whole)
            n = np.array(rows, np.int64).reshape(-1, len(numbers))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "key", "task", "chunk")), *(pa.array(n[:, c].copy()) for c in range(len(numbers))), pa.array(texts, pa.string())],
                names=["conv_id", "key", "task", "chunk", *numbers, "rendered"],
            )

    schema = with_id(parts.schema["conv_id"].dataType, "key string, task int, chunk int, " + ", ".join(f"{c} long" for c in numbers) + ", rendered string")
    return parts.select("conv_id", "key", "task", "chunk", "t", "enter", "togo", "last").mapInArrow(lean(run), schema)


def repair(turns: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per conversation: conv_id, n_in, n_out, cost, merged, relabelled, inserted, rendered."""
    store = Store(turns.sparkSession)
    machine = Machine(p)
    parts = parts_of(turns, machine, p, store)
    long = store.save(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "long")
    n_long = long.count()
    none = {"enter": F.lit(None).cast("int"), "togo": F.lit(None).cast("array<long>"), "last": F.lit(None).cast("boolean")}
    cols = ["conv_id", "n_in", "n_out", "cost", "merged", "relabelled", "inserted", "rendered"]
    if not n_long:
        return rendered(parts.withColumns(none), machine, p).select(*cols)
    long = small(long, n_long, 64)
    lone = rendered(parts.join(long, "key", "left_anti").withColumns(none), machine, p).select(*cols)
    cut = parts.join(long, "key", "left_semi")
    ends = store.save(chained(cut, machine, store), "ends")
    pieces = rendered(cut.join(ends, ["key", "task", "chunk"]), machine, p)
    sums = [F.sum(c).alias(c) for c in cols[1:-1]]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "chunk", "rendered"))), lambda x: x["rendered"]), "")
    whole = pieces.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *sums, text.alias("rendered"))
    return lone.unionByName(whole.select(*cols))
