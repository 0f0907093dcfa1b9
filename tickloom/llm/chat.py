"""Operator 9, chat formatting: budgeted, turn-aligned windows with a loss mask.

Prefix sums of turn tokens choose the spans: a window takes turns until the budget is full, begins
with the system turn and with limited history repeated from the window before, and masks what is
repeated, so that each assistant text is a target once.

A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside roles
and texts a backslash goes between ``<`` and ``|``, and one more where some stand there already, so
no text holds a control string and taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pieces import WITH_SPACE, worker_pieces
from tickloom.llm.shared import partitions

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
WINDOW_SQL = "conv_id long, window int, first_turn long, n_turns int, n_tokens long, repeated_chars long, text string, loss array<struct<start:long,end:long>>"
WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("repeated_chars", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the places of the escaped text, of each turn."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        head = text.index("\n", at)
        end = text.index(END, head + 1)
        yield unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), head + 1, end
        at = end + len(END) + 1


class _Conversation:
    """Turns of one conversation, in order; keeps the system turn, the history and the window being filled only."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system = None
        self.recent: list[tuple] = []  # turns before the window, to repeat
        self.fresh: list[tuple] = []
        self.spent = self.window = self.seen = 0
        self.first = 0

    def repeated(self) -> list[tuple]:
        return ([self.system] if self.system and self.window else []) + self.recent

    def add(self, role: str, formatted: str, head: int, size: int) -> Iterator[dict]:
        turn = (role, formatted, head, size)
        if self.fresh and self.spent + size > self.budget:
            yield self.close()
            while self.recent and sum(t[3] for t in self.repeated()) + size > self.budget:
                self.recent.pop(0)
            self.spent = sum(t[3] for t in self.repeated())
        if not self.fresh:
            self.first = self.seen
        self.fresh.append(turn)
        self.spent += size
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1

    def close(self) -> dict:
        before = self.repeated()
        text, loss = "".join(t[1] for t in before), []
        repeated = len(text)
        parts, at = [text], repeated
        for role, formatted, head, _ in self.fresh:
            if role == "assistant":
                loss.append({"start": at + head, "end": at + len(formatted) - len(END) - 1})
            parts.append(formatted)
            at += len(formatted)
        out = {"conv_id": self.conv, "window": self.window, "first_turn": self.first, "n_turns": len(self.fresh), "n_tokens": self.spent, "repeated_chars": repeated, "text": "".join(parts), "loss": loss}
        tail, held = [], 0
        for t in reversed([x for x in [*self.recent, *self.fresh] if x is not self.system]):
            if held + t[3] > self.history:
                break
            tail.insert(0, t)
            held += t[3]
        self.recent, self.fresh, self.window = tail, [], self.window + 1
        return out


def _by_conversation(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key, *order)


def format_conversations(turns: DataFrame, tokenizer: str, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of all conversations: ``conv_id``, ``window``, ``first_turn``, ``n_turns`` and ``n_tokens``, ``repeated_chars`` (so many characters at the start repeat what was before), ``text``, and ``loss``, the spans of ``text`` that are targets.

    ``turns``: ``conv_id``, ``turn``, ``role``, ``text``. A conversation's rows are sorted by turn
    (then role and text) and streamed, so one of any length needs the memory of a window. A window
    has at most ``budget`` tokens, of the byte-level ``tokenizers`` file, unless one turn alone has
    more: a turn is never cut. ``history``: tokens of earlier turns that a window repeats at most. A
    first turn with role ``system`` is repeated in every window, which therefore has more than
    ``budget`` where that turn and one other have. A turn ends with one line feed after a sign, where
    the tokenizer cuts, so a window's tokens are those of its turns, control strings included.

    Null roles and texts are empty. Rows without a conversation id are one conversation with a null
    id; null turns come first. Repeated rows are turns of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    content = Path(tokenizer).read_text(encoding="utf-8")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, now = worker_pieces(content, WITH_SPACE), None
        for batch in batches:
            out: list[dict] = []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            heads = [f"{START}{escape_role(r)}\n" for r in roles]
            turns = [f"{head}{escape(t)}{END}\n" for head, t in zip(heads, texts, strict=True)]
            for conv, role, head, turn, size in zip(batch.column("conv_id").to_pylist(), roles, heads, turns, pieces.lengths(pa.array(turns, pa.string())).tolist(), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.close())
                    now = _Conversation(conv, budget, history)
                out += now.add(role, turn, len(head), size)
            yield pa.RecordBatch.from_pylist(out, WINDOW)
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], WINDOW)

    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", none("role"), none("text"))
    return _by_conversation(rows, "conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(windows, WINDOW_SQL)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Of each conversation, parsed from its windows: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256`` and ``formatted_chars``."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False

        def row():
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if not started or now[0] != w["conv_id"]:
                    if started:
                        out.append(row())
                    now, started = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, text, _, _ in parse(w["text"][w["repeated_chars"] :]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode("utf-8", "surrogatepass"))
                now[5] += len(w["text"])
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DIGEST, strict=True)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), _DIGEST, strict=True)], names)

    return _by_conversation(windows, "conv_id", "window").mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
