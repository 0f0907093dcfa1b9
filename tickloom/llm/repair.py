"""Operator 12, conversation structure repair: the cheapest edits that make turns alternate.

Repaired roles are ``(s?(ua)+)?`` by initials. Four states tell where such a sequence stands, so
what is still to pay from a row on is four numbers, and the best next edit of each state is two bits.

Two passes stream each conversation, repartitioned by conversation and sorted by turn. The first
goes backward over short rows (a role's initial, a fault): the numbers are carried from batch to
batch, and the edits of many rows, a byte a row, are rows of its output, which Spark writes to the
shared folder. The second goes forward over the texts, where each block of edits sorts ahead of the
rows that it is for. A conversation of any length needs the memory of a batch, its blocks of the
current rows and its audit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import partitions, stash

#: White space that blank texts consist of.
SPACE = " \t\n\x0b\f\r"
#: Rows whose edits make a block.
BLOCK_ROWS = 1 << 16
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
#: Where a repaired sequence stands: nothing yet, a system turn alone, after a user's, after an assistant's turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What comes next, and what an inserted or rerolled turn becomes.
FOLLOWS, NEXT_ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Edits in the order of their initials, as two bits.
EDITS = "DIKR"
FAULTS = ("blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def kept(state: int, initial: str) -> int | None:
    """The state after a row is kept as it is, if it may be."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return FOLLOWS[state] if initial == "?ua"[FOLLOWS[state] - 1] else None


class _Costs:
    """Cost from a row on for each state, and the edits that cost it; what was worked out once is remembered, as only differences matter."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, tuple, int]] = {}

    def end(self) -> tuple:
        return (0, 2 * INSERT, INSERT, 0)

    def before(self, after: tuple, initial: str, fault: int) -> tuple[int, tuple]:
        """The row's edits (two bits for each state) and the costs from it on."""
        least = min(after)
        key = (tuple(c - least for c in after), initial, fault)
        if key not in self.known:
            self.known[key] = self._work_out(*key)
        edits, costs = self.known[key]
        return edits, tuple(c + least for c in costs)

    def _work_out(self, after: tuple, initial: str, fault: int) -> tuple[int, tuple]:
        best = []
        for state in range(4):
            ways = {"D": DELETE + after[state]}
            if fault not in (BLANK, DUPLICATE):
                more = KEEP_TRUNCATED if fault == TRUNCATED else 0
                ways["R"] = REROLE + more + after[FOLLOWS[state]]
                if (to := kept(state, initial)) is not None:
                    ways["K"] = more + after[to]
            best.append(min((cost, edit) for edit, cost in ways.items()))
        for _ in range(3):  # an inserted turn leads to another state of the same row
            best = [min(best[state], (INSERT + best[FOLLOWS[state]][0], "I")) for state in range(4)]
        return sum(EDITS.index(edit) << 2 * state for state, (_, edit) in enumerate(best)), tuple(cost for cost, _ in best)


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_BLOCK = "_key string, has_turn boolean, turn long, role string, digest string, block long, edits binary, " + ", ".join(f"{c} long" for c in _TOTALS)


class _Backward:
    """One conversation from its last row to its first."""

    def __init__(self, key: str, costs: _Costs, block_rows: int):
        self.key, self.table, self.block_rows = key, costs, block_rows
        self.costs, self.edits, self.block = costs.end(), bytearray(), 0
        self.faults, self.illegal, self.n = [0, 0, 0, 0], 0, 0
        self.initial = self.last = None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, has_turn: bool, turn: int, role: str, digest: str, fault: int) -> Iterator[tuple]:
        initial = role[:1]
        edits, self.costs = self.table.before(self.costs, initial, fault)
        self.edits.append(edits)
        self.faults[fault] += 1
        if self.n and initial + self.initial not in ("su", "ua", "au"):
            self.illegal += 1
        if has_turn:
            if self.last_turn is None:
                self.last_turn = turn
            if turn != self.first_turn:
                self.turns += 1
            self.first_turn = turn
        self.initial, self.last, self.n = initial, (has_turn, turn, role, digest), self.n + 1
        if len(self.edits) == self.block_rows:
            yield self.close_block()

    def close_block(self) -> tuple:
        out = (self.key, *self.last, self.block, bytes(reversed(self.edits)), *[None] * len(_TOTALS))
        self.edits, self.block = bytearray(), self.block + 1
        return out

    def close(self) -> Iterator[tuple]:
        if self.edits:
            yield self.close_block()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        yield (self.key, None, None, None, None, None, None, gaps, *self.faults[1:], self.illegal, self.costs[NONE] if self.n else 0)


class _Forward:
    """One conversation from its first row to its last, by the edits worked out before."""

    def __init__(self, key: str):
        self.key, self.state, self.hash = key, NONE, sha256()
        self.blocks, self.at = deque(), 0
        self.audit, self.totals, self.n = bytearray(), [0] * len(_TOTALS), 0

    def tell(self, role: str, text: str) -> None:
        if self.n:
            self.hash.update(b"\n")
        self.hash.update(role.encode("utf-8", "surrogatepass") + b":")
        self.hash.update(text.encode("utf-8", "surrogatepass"))
        self.n += 1

    def insert(self) -> None:
        self.audit += b"I"
        self.tell(NEXT_ROLE[self.state], "")
        self.state = FOLLOWS[self.state]

    def add(self, role: str, text: str) -> None:
        edits = self.blocks[0][self.at]
        self.at += 1
        if self.at == len(self.blocks[0]):
            self.blocks.popleft()
            self.at = 0
        while (edit := EDITS[edits >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += edit.encode()
        if edit == "R":
            self.tell(NEXT_ROLE[self.state], text)
            self.state = FOLLOWS[self.state]
        elif edit == "K":
            self.tell(role, text)
            self.state = kept(self.state, role[:1])

    def close(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        return (self.key, *self.totals, self.audit.decode(), self.hash.hexdigest())


def _short_rows(turns: DataFrame) -> DataFrame:
    """``_key``, sort columns and ``fault`` of every row, without its text.

    A row seen earlier in its conversation is one whose role and text have an earlier turn, found by
    an aggregation that meets each such pair once; equal rows of one turn stand side by side, where
    the pass itself sees the second.
    """
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    own = turns.select("_key", "has_turn", "turn", "role", "digest", "there", F.when(ends == "", BLANK).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault"))
    at = F.struct("has_turn", "turn")
    seen = own.where("there").groupBy(F.col("_key").alias("_k"), F.col("digest").alias("_d")).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    both = own.join(seen, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_d")), "left")
    return both.select("_key", "has_turn", "turn", "role", "digest", "there", "fault", F.coalesce(at > F.col("_first"), F.lit(False)).alias("again"))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _edit_blocks(short: DataFrame, block_rows: int) -> DataFrame:
    """Backward over the short rows: blocks of edits, and one row of totals for each conversation."""

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs, now, held = _Costs(), None, None
        for frame in frames:
            out: list[tuple] = []
            for key, has_turn, turn, role, digest, there, fault, again in frame.itertuples(index=False, name=None):
                if now is None or now.key != key:
                    if now:
                        if held:
                            out += now.add(*held)
                        out += now.close()
                    now, held = _Backward(key, costs, block_rows), None
                if not there:
                    continue
                row = (has_turn, turn, role, digest, DUPLICATE if again and fault != BLANK else fault)
                # Of equal rows side by side all but the first (here: the last that comes) are duplicates.
                if held:
                    same = held[:4] == row[:4] and held[4] != BLANK
                    out += now.add(*held[:4], DUPLICATE if same else held[4])
                held = row
            yield _frame(out, _BLOCK)
        if now:
            yield _frame([*(now.add(*held) if held else ()), *now.close()], _BLOCK)

    order = [F.col("has_turn").desc(), F.col("turn").desc(), F.col("role").desc(), F.col("digest").desc()]
    rows = short.repartition(partitions(short.sparkSession), "_key").sortWithinPartitions(F.col("_key"), *order)
    return rows.mapInPandas(backward, _BLOCK)


_REPAIRED = "_key string, " + ", ".join(f"{c} long" for c in _TOTALS) + ", audit string, repaired_sha256 string"


def _repaired(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Forward over the texts and the blocks."""

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for frame in frames:
            out: list[tuple] = []
            for row in frame[["_key", "role", "text", "there", "edits", "totals"]].itertuples(index=False, name=None):
                key, role, text, there, edits, totals = row
                if now is None or now.key != key:
                    if now:
                        out.append(now.close())
                    now = _Forward(key)
                if totals is not None:
                    now.totals = list(totals)
                elif edits is not None:
                    now.blocks.append(edits)
                elif there:
                    now.add(role, text)
            yield _frame(out, _REPAIRED)
        if now:
            yield _frame([now.close()], _REPAIRED)

    texts = turns.select("_key", "has_turn", "turn", "role", "digest", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_block"), "text", "there", F.lit(None).cast("binary").alias("edits"), F.lit(None).cast("array<long>").alias("totals"))
    whole = F.when(F.col("block").isNull(), F.array(*_TOTALS))
    known = blocks.select("_key", "has_turn", "turn", "role", "digest", F.lit(0).alias("_kind"), (-F.col("block")).alias("_block"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("there"), "edits", whole.alias("totals"))
    rows = texts.unionByName(known).repartition(partitions(turns.sparkSession), "_key").sortWithinPartitions("_key", "has_turn", "turn", "role", "digest", "_kind", "_block")
    return rows.mapInPandas(forward, _REPAIRED)


def repair_conversations(turns: DataFrame, *, present: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    A row's first fault counts: blank, duplicate (its role and text came earlier), truncated (its
    last sign other than white space doesn't end a sentence). Edits are Keep, Rerole (to user or
    assistant, 1), Delete (2; blank and duplicate rows must go) and Insert (an empty turn, 5); a
    truncated row that stays costs 5 more. ``audit``: the initials of the cheapest edits, of equally
    cheap ones the least string. The hash is of the repaired ``role:text``, joined by line feeds.
    ``gaps``: turns missing between the first and the last; 0 where no row has a turn.
    ``illegal``: neighbours whose roles' initials aren't su, ua or au.

    ``present``: a boolean column; rows where it isn't true are missing, though their conversation is
    told of: without rows it has zeros, an empty audit and the hash of nothing.

    Rows are taken by turn (nulls first), those of one turn by role and then by a hash of role and
    text. Null roles and texts are one space. Rows without a conversation id are one conversation.
    Repeated rows are duplicates. An empty table gives no rows. Other columns are ignored, whatever
    their names. A conversation is streamed by one task in each pass.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        F.col("conv_id").cast("string").alias("_key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("there"),
    )
    blocks = stash(_edit_blocks(_short_rows(rows), block_rows), "edits")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _repaired(rows, blocks).select(F.col("_key").cast(kind).alias("conv_id"), *_TOTALS, "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """Faults at known places, for tests of the repair: by the CRC-32 of ``conv_id:turn`` a row in 20 each is missing (``present`` is false), loses its text, its sentence ends, is told twice, or becomes the user's. Nulls in texts, roles and the keys are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("_kind"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), copies.alias("copy"))
