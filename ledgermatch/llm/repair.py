"""Conversation structure: faults of turns, and the cheapest edits that make the roles a conversation again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.common import checked_broadcast, materialize

#: The grammar of roles, ``C -> empty | T | s T``, ``T -> P | T P``, ``P -> u a``, as an LR table: shifts by state and role initial,
#: completed rules by state (symbol, length), states after a symbol, and states in which a conversation may end.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (4, "u"): 2, (2, "a"): 6}
DONE = {6: ("P", 2), 5: ("T", 1), 7: ("T", 2)}
AFTER = {(0, "P"): 5, (1, "P"): 5, (0, "T"): 3, (1, "T"): 4, (3, "P"): 7, (4, "P"): 7}
ENDS = (0, 3, 4)
#: What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
#: A top that costs more than this above the cheapest one cannot win: any top goes on as any other would for an inserted
#: assistant turn and a deleted system turn at most.
SLACK = INSERT + DELETE
#: Letters of an audit that are held as one string.
_CHUNK = 256


@dataclass
class Node:
    """A state on the graph-structured stack; several tops may stand on one node."""

    state: int
    below: Node | None = None


@dataclass
class Top:
    """A stack top with the least (cost, audit) of all readings that reach it, and the digest of its repaired turns so far.

    After each row the tops are ranked by their audits. Two tops of one row never have audits of which one begins the other, since
    both end with the letter of that row. So until the next row an audit is known by the rank of its top and the letters added to it.
    """

    node: Node
    cost: int = 0
    rank: int = 0
    letters: str = ""
    audit: tuple = ()  # (earlier, letters) in chunks
    tail: str = ""
    digest: object = field(default_factory=sha256)
    said: tuple = ()  # (earlier, line) not yet in the digest
    empty: bool = True

    @property
    def order(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.letters

    def edit(self, letter: str, cost: int) -> Top:
        return replace(self, cost=self.cost + cost, letters=self.letters + letter)

    def shift(self, initial: str, line: str, letter: str, cost: int) -> Top | None:
        state = SHIFT.get((self.node.state, initial))
        if state is None:
            return None
        node = Node(state, self.node)
        while node.state in DONE:
            symbol, size = DONE[node.state]
            for _ in range(size):
                node = node.below
            node = Node(AFTER[node.state, symbol], node)
        said = (self.said, line if self.empty else "\n" + line)
        return replace(self, node=node, cost=self.cost + cost, letters=self.letters + letter, said=said, empty=False)

    def settle(self, rank: int) -> None:
        """Put the waiting lines into a digest of one's own, and the letters into the audit."""
        lines = []
        while self.said:
            self.said, line = self.said
            lines.append(line)
        if lines:
            self.digest = self.digest.copy()
            for line in reversed(lines):
                self.digest.update(line.encode())
        self.rank, self.tail, self.letters = rank, self.tail + self.letters, ""
        if len(self.tail) >= _CHUNK:
            self.audit, self.tail = (self.audit, self.tail), ""

    def whole_audit(self) -> str:
        parts, chain = [self.tail], self.audit
        while chain:
            chain, part = chain
            parts.append(part)
        return "".join(reversed(parts))


def _merge(tops: dict[int, Top], new: Top | None) -> bool:
    """Keep the least (cost, audit) of a state."""
    if new is None:
        return False
    old = tops.get(new.node.state)
    if old is not None and old.order <= new.order:
        return False
    tops[new.node.state] = new
    return True


def _with_inserts(tops: dict[int, Top]) -> dict[int, Top]:
    tops = dict(tops)
    todo = list(tops.values())
    while todo:
        top = todo.pop()
        for initial, name in NAMES.items():
            new = top.shift(initial, f"{name}:", "I", INSERT)
            if _merge(tops, new):
                todo.append(new)
    return tops


class Conversation:
    """One conversation, fed turn by turn: counts of faults, and the stack tops. Holds no turns."""

    def __init__(self, key) -> None:
        self.key, self.rows = key, 0
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple | None = None
        self.tops = {0: Top(Node(0))}

    def feed(self, turn, role: str, text: str, repeated: bool) -> None:
        """``repeated``: the same role and text stand in a row of an earlier turn."""
        if turn is not None:
            if self.turns == 0:
                self.least = turn
            self.turns += turn != self.most
            self.most = turn
        solid = _SOLID.search(text)
        repeated = repeated or self.last == (turn, role, text)
        initial = role[:1]
        if self.last is not None and self.last[1][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = (turn, role, text)
        self.rows += 1
        cut = False
        if not solid:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        else:
            cut = text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            self.truncated += cut
        more = TRUNCATED if cut else 0
        after: dict[int, Top] = {}
        for top in _with_inserts(self.tops).values():
            _merge(after, top.edit("D", DELETE))
            if solid and not repeated:
                _merge(after, top.shift(initial, f"{role}:{text}", "K", more))
                for letter, name in NAMES.items():
                    _merge(after, top.shift(letter, f"{name}:{text}", "R", REROLE + more))
        least = min(top.cost for top in after.values())
        self.tops = {state: top for state, top in after.items() if top.cost <= least + SLACK}
        for rank, top in enumerate(sorted(self.tops.values(), key=lambda t: (t.rank, t.letters))):
            top.settle(rank)

    def result(self) -> tuple:
        best = min((top for state, top in _with_inserts(self.tops).items() if state in ENDS), key=lambda t: t.order)
        best.settle(0)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.whole_audit(), best.digest.hexdigest()


RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None) -> DataFrame:
    """Per conversation its faults, the cheapest repair and the digest of the repaired turns.

    Rows are taken by turn, nulls first, then by role and text. The first fault of a row counts: blank (no character but space
    and U+0009 to U+000D), duplicate (role and text seen earlier) or truncated (the last such character is not ``.``, ``!`` or ``?``). ``illegal``
    counts neighbours whose role initials do not follow each other, ``gaps`` the turn numbers that are missing between the least and the
    largest.

    The repaired roles follow ``(s?(ua)+)?``. A turn is kept (K, 0), gets another role (R, 3) or is deleted (D, 4; a must for blank
    and duplicate turns); empty turns are inserted (I, 3); a truncated turn that stays adds 3. A generalised LR parser reads
    the turns with a graph-structured stack: every edit shifts or skips, equal stack tops are merged by the least (cost, audit), so a row
    meets five tops at most. ``audit`` holds the letters of the edits in order.

    One shuffle by conversation and a sort inside partitions; the parser then streams the sorted rows and keeps a few stack tops, each with a
    running SHA-256, whatever the length of a conversation. The digest of a conversation is one pass over its turns in order, so a
    conversation is read by one task. Repeated (role, text) pairs are counted before, combined map-side, so no task holds the texts of a conversation.

    ``absent`` names a boolean column; rows for which it is true only make their conversation appear. A conversation without rows has
    zeros, an empty audit and the digest of an empty text. A null role or text is one space. Rows without a conversation are one conversation.
    """
    column = lambda c: F.col(f"`{c}`")
    gone = F.coalesce(column(absent), F.lit(False)) if absent else F.lit(False)
    rows = turns.select(
        column(conv_id).alias("c"), column(turn).cast("long").alias("t"), gone.alias("gone"),
        F.coalesce(column(role), F.lit(" ")).alias("role"), F.coalesce(column(text), F.lit(" ")).alias("text"),
    )
    place = F.struct(F.col("t").isNotNull().alias("known"), F.coalesce("t", F.lit(0)).alias("turn"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    said = rows.filter(~F.col("gone")).select(F.col("c").alias("c2"), digest.alias("said"), place.alias("at"))
    # only what is said twice or more; one small row each
    often = said.groupBy("c2", "said").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).filter("n > 1").drop("n")
    often = materialize(often, "repair-repeats")
    same = F.col("c").eqNullSafe(F.col("c2")) & (F.col("digest") == F.col("said"))
    marked = rows.withColumn("digest", digest).join(checked_broadcast(often, "8"), same, "left")
    marked = marked.select("c", "t", "gone", "role", "text", F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated"))
    by_turn = marked.repartition("c").sortWithinPartitions(F.col("c").asc(), F.col("t").asc_nulls_first(), "role", "text")
    key = turns.schema[conv_id].dataType
    longs = ", ".join(f"{c} long" for c in RESULTS[:6])
    out = by_turn.mapInArrow(_parse, f"c {key.simpleString()}, {longs}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("c", conv_id)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Conversation | None = None
    done: list[tuple] = []
    kind = None

    def rows():
        columns = list(zip(*done, strict=True))
        done.clear()
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["c", *RESULTS])

    for batch in batches:
        kind = batch.schema.types[0]
        for key, turn, gone, role, text, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.result())
                now = Conversation(key)
            if not gone:
                now.feed(turn, role, text, repeated)
            if len(done) >= 1000:
                yield rows()
    if now is not None:
        done.append(now.result())
        yield rows()
