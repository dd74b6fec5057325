"""Conversation structure repair by Hirschberg divide and conquer.

A conversation is legal if its role initials read ``(s?(ua)+)?``.  Its rows, by turn, are
repaired at least cost: Keep 0, Rerole to user or assistant 2, Delete 3 (the only choice for
a blank row or a duplicate), Insert an empty user or assistant row 2; a truncated row that
isn't deleted adds 1.  The *audit* is the edits' initials in order; of several cheapest
repairs the one with the ASCII-least audit is taken.

**Four states.**  What has been read is empty (0), one system row (1), or ends with a user
(2) or an assistant row (3); 0 and 3 are legal ends.  A step is a row's edit with the
insertions before it, so an audit names one path, and no audit up to a row is a prefix of
another one up to that row.  That makes the order of audits a matter of four ranks: a
forward vector holds, per state, the least cost and the rank of its least audit, and a step
computes the next vector from it alone.

**Hirschberg.**  A forward vector from the start and a backward vector from the end meet
in the middle; of the states with the least sum the one with the least forward rank is the
crossing, and both halves are solved in the same way.  Only two vectors live at a time.
Vectors are kept relative to their least cost, so that there are few of them: a worker
looks up a step it has met before.

**Hot conversations.**  Rows are range-partitioned by (conversation, turn), so a
conversation of any length lies in as many partitions as it needs, and cut into blocks of
at most ``block`` rows.  Blocks whose conversation ends elsewhere give a 4 x 4 table
(costs and ranks from each entry state); one group per such conversation holds a few
hundred bytes per block, meets the vectors at block borders, and fixes each block's entry
and exit state; then the blocks are solved apart from each other.  Equal rows of a turn
travel as one row with a count.

Defined results: a null role or text is one space; null turns come first; rows of equal turn
are ordered by 128-bit digests of role and text, which also decide duplicates; a null id is a
conversation like any other; an empty table gives an empty result.  Columns other than the
four named ones don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import SPACE_CLASS, persisted, worker_state

DELETE, KEEP, REROLE, INSERT = 3, 0, 2, 2
TRUNCATED = 1
#: Row codes: role class (s, u, a, other), plus 4 if truncated; 8 must be deleted.
MUST_DELETE = 8
START = 0
_INITIALS = "sua"
#: state -> (state, cost, audit) after useful insertions (longer ones only go in circles)
_INSERTED = {0: [(0, 0, ""), (2, 2, "I"), (3, 4, "II")], 1: [(1, 0, ""), (2, 2, "I"), (3, 4, "II")],
             2: [(2, 0, ""), (3, 2, "I")], 3: [(3, 0, ""), (2, 2, "I")]}
#: Insertions that end a conversation legally.
TAIL = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
_LEGAL_PAIRS = {"su", "ua", "au"}


def _edits(state: int, code: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) of the edits of a row met in ``state``."""
    out = [(state, DELETE, "D")]
    if code != MUST_DELETE:
        extra = TRUNCATED if code & 4 else 0
        role = code & 3
        to = 3 if state == 2 else 2
        if (role == 0 and state == 0) or (role == 1 and to == 2) or (role == 2 and to == 3):
            out.append((1 if role == 0 else to, KEEP + extra, "K"))
        out.append((to, REROLE + extra, "R"))
    return out


def _steps(code: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a row with the insertions before it."""
    return [(t, y, c0 + c1, a0 + a1) for t, ins in _INSERTED.items() for x, c0, a0 in ins
            for y, c1, a1 in _edits(x, code)]


Vector = tuple  # per state None or (cost above the vector's least, rank)


class Chain:
    """Steps of vectors, remembered once computed; ids stand for vectors."""

    def __init__(self):
        self.steps = [_steps(c) for c in range(9)]
        self.vectors: list[Vector] = []
        self.ids: dict[tuple, int] = {}
        self.ahead: dict[int, tuple[int, int]] = {}
        self.back: dict[int, tuple[int, int]] = {}

    def _id(self, v: Vector) -> int:
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
        return self.ids[v]

    def unit(self, state: int) -> int:
        return self._id(tuple((0, 0) if s == state else None for s in range(4)))

    def _forward_step(self, i: int, code: int) -> tuple[int, int]:
        v = self.vectors[i]
        best: dict[int, tuple] = {}
        for t, y, cost, audit in self.steps[code]:
            if v[t] is not None:
                key = (v[t][0] + cost, v[t][1], audit)
                if y not in best or key < best[y]:
                    best[y] = key
        least = min(k[0] for k in best.values())
        order = sorted(best, key=lambda y: best[y][1:])
        return self._id(tuple((best[y][0] - least, order.index(y)) if y in best else None for y in range(4))), least

    def _backward_step(self, i: int, code: int) -> tuple[int, int]:
        v = self.vectors[i]
        best: dict[int, int] = {}
        for t, y, cost, _ in self.steps[code]:
            if v[y] is not None:
                best[t] = min(best.get(t, 1 << 30), v[y][0] + cost)
        least = min(best.values())
        return self._id(tuple((best[t] - least, 0) if t in best else None for t in range(4))), least

    def forward(self, codes: bytes, state: int) -> tuple[int, Vector]:
        """(cost, vector) after the rows, entered in ``state``."""
        v, total, seen = self.unit(state), 0, self.ahead
        for c in codes:
            k = v * 16 + c
            got = seen.get(k)
            if got is None:
                got = seen[k] = self._forward_step(v, c)
            v = got[0]
            total += got[1]
        return total, self.vectors[v]

    def backward(self, codes: bytes, state: int) -> Vector:
        """Costs (above their least) of leaving the rows in ``state``, by entry state."""
        v, seen = self.unit(state), self.back
        for c in reversed(codes):
            k = v * 16 + c
            got = seen.get(k)
            if got is None:
                got = seen[k] = self._backward_step(v, c)
            v = got[0]
        return self.vectors[v]

    def crossing(self, ahead: Vector, behind: Vector) -> int:
        """The audit-least state on a cheapest path through the meeting point."""
        return min((a[0] + b[0], a[1], s) for s, (a, b) in enumerate(zip(ahead, behind, strict=True))
                   if a is not None and b is not None)[2]

    def solve(self, codes: bytes, start: int, end: int) -> str:
        """Audit of the cheapest, then audit-least, way from ``start`` to ``end``."""
        out, todo = [], [(0, len(codes), start, end)]
        while todo:
            lo, hi, s, e = todo.pop()
            if hi - lo == 1:
                out.append(min((c, a) for t, y, c, a in self.steps[codes[lo]] if t == s and y == e)[1])
            elif hi > lo:
                mid = (lo + hi) // 2
                x = self.crossing(self.forward(codes[lo:mid], s)[1], self.backward(codes[mid:hi], e))
                todo += [(mid, hi, x, e), (lo, mid, s, x)]
        return "".join(out)

    def repair(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit) of a whole conversation."""
        cost, v = self.forward(codes, START)
        end = min((x[0] + TAIL[s][0], x[1], s) for s, x in enumerate(v) if x is not None)
        return cost + end[0], self.solve(codes, START, end[2]) + TAIL[end[2]][1]

    def table(self, codes: bytes) -> list[int]:
        """Cost and rank (-1: no way) of every exit state from every entry state."""
        out = []
        for t in range(4):
            base, v = self.forward(codes, t)
            for x in v:
                out += (-1, -1) if x is None else (base + x[0], x[1])
        return out


def cross_blocks(tables: list[list[int]]) -> tuple[int, list[int]]:
    """(cost, states at the borders of the blocks) for the tables of a conversation's
    blocks in order: forward vectors with ranks, then the crossings from the end."""
    ahead: list[Vector] = [tuple((0, 0) if s == START else None for s in range(4))]
    for m in tables:
        best: dict[int, tuple] = {}
        for t, x in enumerate(ahead[-1]):
            for y in range(4):
                cost, rank = m[t * 8 + 2 * y], m[t * 8 + 2 * y + 1]
                if x is not None and cost >= 0:
                    best[y] = min(best.get(y, (1 << 62,)), (x[0] + cost, x[1], rank))
        order = sorted(best, key=lambda y: best[y][1:])
        ahead.append(tuple((best[y][0], order.index(y)) if y in best else None for y in range(4)))
    behind: dict[int, int] = {s: c for s, (c, _) in TAIL.items()}
    states, cost = [], None
    for i in range(len(tables), -1, -1):
        total, _, s = min((x[0] + behind[s], x[1], s) for s, x in enumerate(ahead[i]) if x is not None and s in behind)
        cost = total if cost is None else cost
        states.append(s)
        if i:  # only the exit that was chosen counts from here on
            m = tables[i - 1]
            behind = {t: m[t * 8 + 2 * s] + behind[s] for t in range(4) if m[t * 8 + 2 * s] >= 0}
    return cost, states[::-1]


# ---- rows, blocks, audits

def marked(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, initial, blank, cut, d1, d2) of every row."""
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))
    return rows.select(
        "*", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^ \x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{SPACE_CLASS}*\z")).alias("cut"),
        F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("d1").asc(), F.col("d2").asc()]


_BLOCK = ("part int, seq int, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, "
          "last string, cost long, audit string, codes binary, costs array<long>")


def _make_blocks(limit: int):
    names = ["conv", *(f.split()[0] for f in _BLOCK.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chain, part = worker_state(("chain",), Chain), TaskContext.get().partitionId()
        conv_type = None
        ready: list[tuple] = []
        block: dict | None = None

        def fresh(conv, begins: bool) -> dict:
            nonlocal made
            made += 1  # numbers the partition's blocks
            return {"conv": conv, "seq": made, "begins": begins, "codes": bytearray(), "faults": [0, 0, 0, 0], "illegal": 0,
                    "first": None, "last": None}

        def finish(b: dict, whole: bool) -> None:
            codes = bytes(b["codes"])
            cost, audit = chain.repair(codes) if whole else (None, None)
            ready.append((b["conv"], part, b["seq"], len(codes), *b["faults"][1:], b["illegal"], b["first"], b["last"],
                          cost, audit, None if whole else codes, None if whole else chain.table(codes)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.string(),
                     pa.binary(), pa.list_(pa.int64())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        made = 0
        for b in batches:
            conv_type = b.schema.field("conv").type
            for conv, initial, fault, copies in zip(*(b.column(c).to_pylist() for c in ("conv", "initial", "fault", "copies")),
                                                    strict=True):
                if block is None or conv != block["conv"]:
                    if block is not None:  # the first one may have begun in another partition
                        finish(block, whole=block["begins"])
                    block = fresh(conv, begins=block is not None)
                for i in range(copies):
                    if len(block["codes"]) >= limit:
                        finish(block, whole=False)
                        block = fresh(conv, begins=False)
                    f = fault if i == 0 else min(fault or 2, 2) if fault != 3 else 2
                    role = _INITIALS.find(initial) if initial else 3
                    block["codes"].append(MUST_DELETE if f in (1, 2) else (role if role >= 0 else 3) + (4 if f == 3 else 0))
                    block["faults"][f] += 1
                    if block["first"] is None:
                        block["first"] = initial
                    else:
                        block["illegal"] += block["last"] + initial not in _LEGAL_PAIRS
                    block["last"] = initial
                if len(ready) >= 2_000:
                    yield batch_of(ready)
                    ready.clear()
        if block is not None:
            finish(block, whole=False)
        if ready:
            yield batch_of(ready)

    return run


def _cross(table: pa.Table) -> pa.Table:
    """Entry and exit states of the blocks of one conversation."""
    t = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    cost, states = cross_blocks(t.column("costs").to_pylist())
    n, first, last = t.num_rows, t.column("first").to_pylist(), t.column("last").to_pylist()
    bridge = [0] + [int(a + b not in _LEGAL_PAIRS) for a, b in zip(last[:-1], first[1:], strict=True)]
    return pa.table({"part": t.column("part"), "seq": t.column("seq"), "entry": pa.array(states[:-1], pa.int32()),
                     "leave": pa.array(states[1:], pa.int32()), "tail": pa.array([False] * (n - 1) + [True]),
                     "bridge": pa.array(bridge, pa.int64()), "total": pa.array([cost] + [0] * (n - 1), pa.int64())})


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain = worker_state(("chain",), Chain)
    for b in batches:
        audits = [chain.solve(c, s, e) + (TAIL[e][1] if tail else "") for c, s, e, tail in zip(
            *(b.column(c).to_pylist() for c in ("codes", "entry", "leave", "tail")), strict=True)]
        keep = [n for n in b.schema.names if n not in ("codes", "entry", "leave", "tail")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(audits, pa.string())], names=[*keep, "audit"])


def audits(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block: int = 65_536) -> DataFrame:
    """Per conversation that has rows: ``conv``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` and ``audit``."""
    rows = marked(conversations, conv_col, turn_col, role_col, text_col)
    kinds = persisted(rows.groupBy("conv", "turn", "d1", "d2", "initial", "blank", "cut").agg(
        F.count(F.lit(1)).alias("copies")), "turn-kinds")
    # the first of equal rows is that with the smallest turn, null before all
    firsts = persisted(kinds.groupBy("conv", "d1", "d2").agg(
        F.bool_or(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("least"),
        F.count(F.lit(1)).alias("n")).filter("n > 1"), "turn-firsts")
    f = firsts.select(F.col("conv").alias("fc"), F.col("d1").alias("f1"), F.col("d2").alias("f2"), "any_null", "least")
    checked = kinds.join(f, F.col("conv").eqNullSafe(F.col("fc")) & (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2")),
                         "left")
    later = F.coalesce(F.when(F.col("any_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least")), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(later, 2).when(F.col("cut"), 3).otherwise(0)
    ordered = checked.select("conv", "turn", "d1", "d2", "initial", fault.alias("fault"), "copies").repartitionByRange(
        *_order()).sortWithinPartitions(*_order())
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    blocks = persisted(ordered.select("conv", "initial", "fault", "copies").mapInArrow(
        _make_blocks(block), T.StructType([conv, *T.StructType.fromDDL(_BLOCK)])), "blocks")
    parts = blocks.filter("audit is null")
    crossed = parts.select("conv", "part", "seq", "first", "last", "costs").groupBy("conv").applyInArrow(
        _cross, "part int, seq int, entry int, leave int, tail boolean, bridge long, total long")
    joined = parts.drop("costs", "audit", "cost").join(persisted(crossed, "crossings"), ["part", "seq"])
    keep = ["conv", "part", "seq", "blank", "duplicate", "truncated", "illegal", "bridge", "total"]
    solved = joined.select(*keep, "codes", "entry", "leave", "tail").mapInArrow(
        _solve_blocks, T.StructType([joined.schema[c] for c in keep]).add("audit", "string"))
    long = solved.groupBy("conv").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + F.sum("bridge")).alias("illegal"), F.sum("total").alias("cost"),
        # one audit of a conversation is one string by definition
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))["audit"], "").alias("audit"))
    whole = blocks.filter("audit is not null").select(*long.columns)
    turns = kinds.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps")).withColumnRenamed("conv", "gc")
    return whole.unionByName(long).join(turns, F.col("conv").eqNullSafe(F.col("gc")), "left").withColumn(
        "gaps", F.coalesce("gaps", F.lit(0).cast("long"))).drop("gc")


# ---- the repaired rows

def _walk(batches: Iterator[pa.RecordBatch]):
    """(conv, None) when a conversation starts, then (role, text) of its repaired rows."""
    audit, at, state = "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at += 1
            state = 3 if state == 2 else 2
            yield ("assistant" if state == 3 else "user"), ""

    for b in batches:
        for conv, given, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
            if given is not None:
                yield from inserted()
                audit, at, state = given, 0, START
                yield None, conv
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            kept_system = edit == "K" and role[:1] == "s"
            state = 1 if kept_system else 3 if state == 2 else 2
            yield (role if edit == "K" else "assistant" if state == 3 else "user"), text
    yield from inserted()


def _streamed(conversations: DataFrame, found: DataFrame, cols: tuple[str, str, str, str]) -> DataFrame:
    """Each conversation's audit, then its rows in order; one conversation in one task, as
    a stream: nothing of it but the audit is held."""
    rows = marked(conversations, *cols).select(
        "conv", F.lit(1).alias("kind"), "turn", "d1", "d2", F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                         F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "audit",
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), "kind", *_order()[1:]).select("conv", "audit", "role", "text")


def repaired(conversations: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows (conv, pos, role, text) for the audits ``found``."""
    rows = _streamed(conversations, found, (conv_col, turn_col, role_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[tuple] = []

        def typed(it):
            nonlocal kind
            for b in it:
                kind = b.schema.field("conv").type
                yield b

        def batch() -> pa.RecordBatch:
            c, p, r, t = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(p, pa.int64()), pa.array(r, pa.string()),
                                               pa.array(t, pa.string())], names=["conv", "pos", "role", "text"])

        conv, pos = None, 0
        for role, text in _walk(typed(batches)):
            if role is None:
                conv, pos = text, 0
                continue
            held.append((conv, pos, role, text))
            pos += 1
            if len(held) >= 1_000:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return rows.mapInArrow(run, T.StructType([rows.schema["conv"]]).add("pos", "long").add("role", "string").add("text", "string"))


def digests(conversations: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, audit, sha256) for the audits ``found``: hash of the repaired rows
    ``role:text`` joined by newlines, taken as they stream by."""
    rows = _streamed(conversations, found, (conv_col, turn_col, role_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kind = None
        done: list[tuple] = []

        def typed(it):
            nonlocal kind
            for b in it:
                kind = b.schema.field("conv").type
                yield b

        def batch() -> pa.RecordBatch:
            c, h = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array([x.hexdigest() for x in h], pa.string())],
                                              names=["conv", "sha256"])

        sha, empty = None, True
        for role, text in _walk(typed(batches)):
            if role is None:
                if len(done) >= 1_000:
                    yield batch()
                    done.clear()
                sha, empty = hashlib.sha256(), True
                done.append((text, sha))
                continue
            sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if done:
            yield batch()

    return rows.mapInArrow(run, T.StructType([rows.schema["conv"]]).add("sha256", "string"))
