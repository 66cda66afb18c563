"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?, by initials.

Turns of a conversation come in order through one streaming pass of its task. A Viterbi step per turn holds one survivor for each state of the machine
(start, after a system turn, after a user turn, after an assistant turn): the cheapest edits so far, of equal ones those whose initials are
least in ASCII. Survivors are paths in a tree of back pointers that counts its references; a path that no survivor takes is freed
at once, and as soon as all survivors share an ancestor, the edits to it are emitted with their turns and leave memory. So a conversation
holds only its unresolved end, however long it is. Survivors that can't win any more (all turns deleted so far) are dropped. Ties compare the whole unresolved ends: jump pointers lead to the last common
ancestor, where the first initials differ. (An end stays unresolved where a shift by one turn would cost the same everywhere, as in a conversation none of
whose roles is known; its turns are then held until it ends.)

Edits and costs: Keep 0; Rerole to user or assistant 2; Delete 3, required for blank and duplicate turns; Insert an empty user or
assistant turn anywhere 2; a truncated turn that stays adds 1. A turn's first fault counts: blank, duplicate (an earlier turn has
role and text), truncated (its last character that isn't white space ends no sentence).

Defined cases: a null role or text is one space; the rows with a null conv_id are one conversation; null turns come first, ties come by role
and text, and repeated rows are duplicates of the first; an empty role or one with another initial can't be kept; very long texts are
hashed by Spark to find duplicates; an empty table gives no rows; other columns, whatever their names, don't enter. Whether a turn is a duplicate is
decided by Spark over (conversation, role, digest of the text), so no set of earlier turns is held.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, WORD_CLASS

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: state -> initial of a role -> next state; the empty conversation and an assistant's turn may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (START, ASSISTANT)
#: The role that a new or renamed turn takes in each state, and where it leads.
WANTED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ADJACENT = ("su", "ua", "au")


class Node:
    """An edit at the end of a path. jump: an ancestor further up, so that the common one of two paths is found in few steps."""

    __slots__ = ("parent", "jump", "depth", "edit", "role", "cost", "refs", "children")

    def __init__(self, parent: Node | None, edit: str = "", role: str | None = None, cost: int = 0):
        self.parent, self.edit, self.role, self.cost, self.refs = parent, edit, role, cost, 0
        self.children: set[Node] = set()
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = parent.depth + 1
            far = parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent


def _raised(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.jump if node.jump.depth >= depth else node.parent
    return node


def less(a: Node, b: Node) -> bool:
    """Whether the initials on the way to a come before those on the way to b. Neither way is the beginning of the other."""
    depth = min(a.depth, b.depth)
    a, b = _raised(a, depth), _raised(b, depth)
    while a.parent is not b.parent:
        a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
    return a.edit < b.edit


class Repair:
    """The repair of one conversation. push() and end() return edits as (edit, role, cost, turn) once they are certain; an inserted turn is None."""

    def __init__(self):
        self.root = Node(None)
        self.best: list[Node | None] = [self.root, None, None, None]
        self.root.refs = 1
        self.turns: deque = deque()  # of the turns whose edits aren't emitted yet
        self.most = 0  # unresolved edits at a time, at most
        self._inserted()

    def _better(self, state: int, a: Node | None, b: Node) -> bool:
        return a is None or b.cost < a.cost or (b.cost == a.cost and less(b, a))

    def _settle(self, found: dict[int, Node]) -> None:
        """Makes found the survivors, and frees what none of them needs."""
        new = [found.get(s) for s in range(4)]
        for n in new:
            if n is not None:
                self._hold(n)
                n.refs += 1
        for n in self.best:
            if n is not None:
                n.refs -= 1
                self._free(n)
        self.best = new

    def _hold(self, n: Node) -> None:
        p = n.parent
        if p is not None and n not in p.children:
            p.children.add(n)
            p.refs += 1

    def _free(self, n: Node) -> None:
        while n.refs == 0 and n.parent is not None:
            p = n.parent
            if n in p.children:
                p.children.remove(n)
                p.refs -= 1
            n.parent = None
            n = p

    def _inserted(self) -> None:
        """Survivors after any inserts: a user turn from each other state, then an assistant's."""
        found = {s: n for s, n in enumerate(self.best) if n is not None}
        for state in (START, SYSTEM, ASSISTANT, USER):
            if (n := found.get(state)) is not None:
                role, to = WANTED[state]
                x = Node(n, INSERT, role, n.cost + COST[INSERT])
                if self._better(to, found.get(to), x):
                    found[to] = x
        # what begins or stays before the first user turn can't win where it costs more than to delete a system turn after an assistant's
        if (last := found.get(ASSISTANT)) is not None:
            for state, more in ((START, COST[DELETE]), (SYSTEM, 0)):
                if state in found and found[state].cost > last.cost + more:
                    del found[state]
        for n in list(found.values()):  # an insert may stand on another
            while n.parent is not None and n not in n.parent.children:
                self._hold(n)
                n = n.parent
        self._settle(found)

    def push(self, initial: str, fault: str | None, turn) -> list[tuple]:
        found: dict[int, Node] = {}
        extra = TRUNCATED_COST if fault == TRUNCATED else 0

        def offer(state: int, n: Node, edit: str, role: str | None, cost: int) -> None:
            x = Node(n, edit, role, n.cost + cost)
            if self._better(state, found.get(state), x):
                found[state] = x

        for state, n in enumerate(self.best):
            if n is None:
                continue
            offer(state, n, DELETE, None, COST[DELETE])
            if fault not in (BLANK, DUPLICATE):
                if (to := MOVES[state].get(initial)) is not None:
                    offer(to, n, KEEP, None, COST[KEEP] + extra)
                role, to = WANTED[state]
                offer(to, n, REROLE, role, COST[REROLE] + extra)
        self.turns.append(turn)
        self._settle(found)
        self._inserted()
        return self._emitted()

    def _emitted(self) -> list[tuple]:
        """Edits up to where the survivors part."""
        out = []
        while self.root.refs == 1 and len(self.root.children) == 1:  # no survivor ends at the root
            (n,) = self.root.children
            out.append((n.edit, n.role, n.cost - self.root.cost, None if n.edit == INSERT else self.turns.popleft()))
            self.root.children, n.parent = set(), None
            self.root = n
        self.most = max(self.most, max(n.depth for n in self.best if n is not None) - self.root.depth)
        return out

    def end(self) -> list[tuple]:
        last = None
        for state in FINAL:
            n = self.best[state]
            if n is not None and (last is None or n.cost < last.cost or (n.cost == last.cost and less(n, last))):
                last = n
        self._settle({START: last})
        way = []
        while last is not self.root:
            way.append(last)
            last = last.parent
        out, before = [], self.root.cost
        for n in reversed(way):
            out.append((n.edit, n.role, n.cost - before, None if n.edit == INSERT else self.turns.popleft()))
            before = n.cost
        return out


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, here) with their fault, conversation by conversation and in order within a task; texts move once."""
    key = F.sha2("text", 256)
    first = F.row_number().over(W.partitionBy("conv_id", "here", "role", key).orderBy(F.col("turn").asc_nulls_first()))
    bare = F.btrim("text", F.lit(WHITE))
    fault = F.when(~F.col("text").rlike(WORD_CLASS), BLANK).when(F.col("seq") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    d = turns.repartition("conv_id").withColumn("seq", first)
    return d.select("conv_id", "turn", "role", "text", "here", "seq", fault.alias("fault")).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seq"
    )


_EDITS = "conv_id {id}, step long, edit string, fault string, role string, text string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
_BATCH = 4096


def _edits(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Edits of conversations that come one after the other; a row without a step closes each."""
    names = [x.split()[0] for x in _EDITS.split(", ")]
    types = [kind, pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 6]
    rows: list[tuple] = []
    step = cost = 0
    own: Repair | None = None
    held: object = None
    counts: dict[str, int] = {}
    span: list[int] = []  # first and last turn, and how many different ones
    before: str | None = None
    was: int | None = None

    def told(edits: list[tuple]) -> None:
        nonlocal step, cost
        for edit, role, price, turn in edits:
            fault, old, text = turn if turn is not None else (None, None, "")
            rows.append((held, step, edit, fault, role if role is not None else old, text, price, *[None] * 5))
            step, cost = step + 1, cost + price

    def closed() -> None:
        told(own.end())
        gaps = span[1] - span[0] + 1 - span[2] if span else 0
        rows.append((held, *[None] * 5, cost, gaps, counts.get(BLANK, 0), counts.get(DUPLICATE, 0), counts.get(TRUNCATED, 0), counts.get("illegal", 0)))

    def batch() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return out

    for found in batches:
        for conv, turn, role, text, here, fault in zip(*(found.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "here", "fault")), strict=True):
            if own is None or conv != held:
                if own is not None:
                    closed()
                own, held, counts, span, before, was, step, cost = Repair(), conv, {}, [], None, None, 0, 0
            if here:
                if fault is not None:
                    counts[fault] = counts.get(fault, 0) + 1
                if turn is not None:
                    if turn != was:
                        span = [span[0], turn, span[2] + 1] if span else [turn, turn, 1]
                    was = turn
                if before is not None and before + role[:1] not in ADJACENT:
                    counts["illegal"] = counts.get("illegal", 0) + 1
                before = role[:1]
                told(own.push(role[:1], fault, (fault, role, text)))
            if len(rows) >= _BATCH:
                yield batch()
    if own is not None:
        closed()
    if rows:
        yield batch()


def repair_edits(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here: Column | None = None) -> DataFrame:
    """conv_id, step (from 0), edit (its initial), fault, role and text after the edit (of a deleted turn: as it was), cost; and for
    each conversation one row without a step, with its cost and gaps, blank, duplicate, truncated and illegal counts. Rows of a
    conversation are neighbours and in order. Rows where ``here`` is false only keep their conversation's id."""
    some = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    own = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), some(role_col).alias("role"), some(text_col).alias("text"), (F.lit(True) if here is None else here).alias("here"))
    kind = own.schema["conv_id"].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64()
    if kind.simpleString() not in ("string", "bigint"):
        own = own.withColumn("conv_id", F.col("conv_id").cast("long"))
    return _ordered(own).mapInArrow(lambda batches: _edits(batches, arrow), _EDITS.format(id="string" if arrow == pa.string() else "long"))


_REPORT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    audit: list[str] = []
    digest, first = hashlib.sha256(), True
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for found in batches:
        rows = []
        columns = ("conv_id", "step", "edit", "role", "text", *counts)
        for conv, step, edit, role, text, *told in zip(*(found.column(n).to_pylist() for n in columns), strict=True):
            if step is None:
                rows.append((conv, *told, "".join(audit), digest.hexdigest()))
                audit, digest, first = [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != DELETE:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if rows:
            names = [x.split()[0] for x in _REPORT.split(", ")]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names)


def repair_reports(edits: DataFrame) -> DataFrame:
    """One row per conversation of repair_edits, which it reads as they come: its counts, cost, audit (the edits' initials) and the digest of the
    repaired turns (role:text, joined by line feeds). Texts aren't gathered; the digest grows turn by turn."""
    arrow = pa.string() if edits.schema["conv_id"].dataType.simpleString() == "string" else pa.int64()
    return edits.mapInArrow(lambda batches: _reports(batches, arrow), _REPORT.format(id="string" if arrow == pa.string() else "long"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by checksum of the ids, to measure repairs by; ``here`` is false where the turn is
    dropped. Nulls of role and text become one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat_ws(":", some("conv_id"), some("turn"))) % 20
    d = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), by.alias("by"))
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("by") != 0).alias("here"), "by")
    return d.withColumn("copy", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("by", "copy")
