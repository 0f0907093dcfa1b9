"""Operator 11, secret scans: known forms of keys, and strings of high entropy.

Strings of the signs that keys are made of are cut in runs of one character class. A window slides
over each run; the counts of the signs in it change by the one that enters and the one that leaves,
and with them the Shannon entropy. Windows over the class's threshold make spans, unless the string
is on the allow list (addresses, ids that are public, alphabets, numbers) or a known form covers them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pieces import balanced

#: The known forms: kind, pattern, the group whose length counts, the least length. Letters of the words in either case, ASCII only.
KNOWN = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # runs are maximal, so this finds the same as all runs and a length
)


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``signs`` are suspect where ``window`` neighbouring signs hold ``bits`` or more each."""

    name: str
    signs: str
    window: int
    bits: float


#: 20 signs hold 4.32 bits each if all differ. Random hex digits hold 3.4 on average, random letters and digits 4.0 to 4.1, words of prose up to about 3.7.
CLASSES = (EntropyClass("hex", "0-9a-fA-F", 20, 3.0), EntropyClass("base64", "A-Za-z0-9+/_=-", 20, 3.9))
#: Strings in which nothing is suspect: words with short numbers behind them joined by signs (paths, names of sites and of variables), identifiers in groups, numbers, alphabets. Each can be read in one way only, so a match costs no more than the string is long.
ALLOWED = (
    r"[A-Z]?[a-z]*[0-9]{0,4}(?:[-_/.=+][A-Z]?[a-z]*[0-9]{0,4})*",
    r"[A-Z]+(?:[-_/.=+][A-Z]+)*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+.=_/-]+",
    r"[A-Za-z0-9]{0,40}(?:abcdefghij|ABCDEFGHIJ|0123456789)[A-Za-z0-9]{0,40}",
)
BATCH_BYTES = 1 << 23
SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ORDER = {kind: k for k, (kind, *_) in enumerate(KNOWN)} | {"entropy": len(KNOWN)}


def known_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the known forms, leftmost and not overlapping by kind; those too short are dropped, not shortened."""
    return [(kind, *m.span()) for kind, pattern, group, least in KNOWN for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def entropy_windows(run: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined stretches of ``run`` whose windows have ``bits`` or more a sign.

    A window's entropy is log2(window) less the mean of log2(count) over its signs; the sum of
    count * log2(count) changes by two terms with each step.
    """
    weight = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    most = (log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, start, end = 0.0, None, 0
    for at, sign in enumerate(run):
        n = counts.get(sign, 0)
        counts[sign] = n + 1
        total += weight[n + 1] - weight[n]
        first = at - window + 1
        if first < 0:
            continue
        if total <= most:
            if start is None or first > end:
                if start is not None:
                    yield start, end
                start = first
            end = at + 1
        left = run[first]
        n = counts[left]
        counts[left] = n - 1
        total += weight[n - 1] - weight[n]
    if start is not None:
        yield start, end


class Scanner:
    """Finds the spans of texts, with patterns compiled once a task."""

    def __init__(self, classes: tuple[EntropyClass, ...], allowed: tuple[str, ...]):
        self.classes = [(c, re.compile(f"[{c.signs}]{{{c.window},}}")) for c in classes]
        least = min((c.window for c in classes), default=1)
        self.candidate = re.compile(f"[A-Za-z0-9+/_.=-]{{{least},}}")
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed)) if allowed else None

    def high_entropy(self, text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found = []
        for c in self.candidate.finditer(text):
            string, at = c.group(), c.start()
            if self.allowed and self.allowed.fullmatch(string):
                continue
            for kind, pattern in self.classes:
                for run in pattern.finditer(string):
                    found += [(at + run.start() + a, at + run.start() + b) for a, b in entropy_windows(run.group(), kind.window, kind.bits)]
        out: list[list[int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [("entropy", a, b) for a, b in out if not any(s <= a and b <= e for _, s, e in known)]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        known = known_spans(text)
        return sorted(known + self.high_entropy(text, known), key=lambda s: (s[1], _ORDER[s[0]]))


def find_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_column`` and ``spans`` of every row: kind (``assign``, ``access``, ``hex``, ``entropy``), start and end (code points, end not included), by start and then by kind.

    ``allowed``: patterns of whole strings in which no entropy is looked for; known forms stay
    whatever the list says. Spans of entropy that lie within a known form aren't told again.

    Whole texts, of any length: what a text costs grows with its length alone. A null text is empty
    and has no spans. A null id stays null, repeated rows are scanned each, an empty table gives no
    rows, other columns are dropped, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in balanced(batches, "text", batch_bytes):
            kinds, starts, ends, upto = [], [], [], [0]
            for text in batch.column("text"):
                for kind, start, end in scanner.spans(text.as_py()):
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
                upto.append(len(kinds))
            each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], fields=list(_SPANS.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(upto, np.int32)), each, type=_SPANS)], [id_column, "spans"])

    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{id_column}` {kind}, spans {SPANS}")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[{kind}]") -> str:
    """``text`` with each span replaced by a mark; overlapping spans are one, of the kind that begins first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join(out) + text[at:]
