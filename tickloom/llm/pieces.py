"""Tokenizer calls on distinct pieces of text.

Both tokenizers used here cut a text at white space before they merge anything, so the tokens of a
text are those of its pieces in order, and a piece needs encoding once per worker. A text with a
control character on whose class Python and the tokenizers disagree stays one piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of white space and the word after it: the tokenizer never joins a word to the white space that follows it.
WITH_SPACE = re.compile(r"\s*\S+|\s+")
#: Words alone, for tokenizers that drop white space.
WORDS = re.compile(r"\S+")
#: White space for Python only (or for old Unicode tables only).
UNSAFE = re.compile("[\x1c-\x1f\u180e]")

#: Texts with other characters than these (up to U+024F, without controls and the dotted capital I) or a special token's first two aren't lower-cased ahead of the tokenizer.
ODD = re.compile(r"[^\t\n\r -~\xa1-\u012f\u0131-\u024f]|<\|")
#: The same in Arrow's syntax.
ODD_ARROW = r"[^\t\n\r -~\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"

#: Bytes of pieces and ids that a worker keeps between batches, about; beyond it the half used least lately is forgotten.
KEPT_BYTES = 40 << 20
#: What a kept piece costs besides its own bytes and its ids: its place in the text and in the pool, its hash and the last batch that had it.
ENTRY_BYTES = 32
#: The end of the pattern of a tokenizer that takes letters by runs, digits one by one and other signs by runs.
LETTERS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs after a letter, at the end of a piece, which such a tokenizer takes as one (an apostrophe may begin an ending).
SIGNS_ARROW = r"([a-z\x{df}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-@\[-`{-~]+)(\s|$)"
#: Lower-case words in Arrow's syntax.
LOWER_ARROW = r"^\p{Ll}+$"
#: Pieces in one call's text, with a special token between each two, and words in one, with a space.
JOINED, WORDS_JOINED = 64, 512


def hashes(texts: pa.Array) -> np.ndarray:
    """64 bits of each string, from its bytes eight at a time."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = texts.type in (pa.large_string(), pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, at = np.arange(len(texts)), 0
    while len(rows):
        rows = rows[lengths[rows] > at]
        block = data[starts[rows, None] + at + np.arange(8)]
        block[np.arange(8) >= (lengths[rows] - at)[:, None]] = 0
        mixed = (out[rows] ^ block.view("<u8")[:, 0]) * np.uint64(0xFF51AFD7ED558CCD)
        out[rows] = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        at += 8
    return out ^ (out >> np.uint64(29))


class Pieces:
    """Token ids of texts, from the ids of their distinct pieces."""

    def __init__(self, tokenizer_json: str, cut: re.Pattern, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut, self.kept_bytes = cut, kept_bytes
        self.by_words, self.ends = self._for_words(tokenizer_json)
        plain = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = plain[0] if plain else None
        #: The kept pieces, their hashes in order, and whose each is.
        self.known, self.hashes, self.owner = pa.array([], pa.large_string()), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: By number: where a piece's ids begin in the pool, how many they are, and the last batch that had the piece.
        self.starts, self.sizes, self.used, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.held = self.batch = 0

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > np.median(self.used))
        ids = self._gathered(keep)
        self.sizes, self.used, self.pool = self.sizes[keep], self.used[keep], ids
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.known = self.known.take(pa.array(keep))
        self._sort(hashes(self.known))
        self.held = self._bytes(self.known, ids)

    def _sort(self, of_known: np.ndarray) -> None:
        self.owner = np.argsort(of_known, kind="stable").astype(np.int32)
        self.hashes = of_known[self.owner]

    @staticmethod
    def _bytes(pieces: pa.Array, ids: np.ndarray) -> int:
        return (pc.sum(pc.binary_length(pieces)).as_py() or 0) + ENTRY_BYTES * len(pieces) + 4 * len(ids)

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces one after another."""
        sizes = self.sizes[numbers]
        upto = np.cumsum(sizes, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if total < 1 << 31 else np.int64
        return self.pool[np.repeat((self.starts[numbers] - upto + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)]

    def _for_words(self, tokenizer_json: str) -> tuple[bool, np.ndarray | None]:
        """Whether texts are lower-cased and cut at everything but letters, and then which ids end a word, if its last letters are marked as such."""
        spec = json.loads(tokenizer_json)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        whole = len(cuts) == 2 and cuts[0].get("pattern", {}).get("Regex", "").endswith(LETTERS) and cuts[0]["invert"] and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        if self.cut is not WORDS or steps != ["NFC", "Replace", "Lowercase"] or not whole:
            return False, None
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        if not suffix:
            return True, None
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        return True, ends

    def _cut(self, text: str) -> list[str]:
        return [text] if UNSAFE.search(text) else self.cut.findall(text)

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts one after another, and where each text's begin and end."""
        plain = pc.invert(pc.match_substring_regex(texts, ODD_ARROW)) if self.by_words else pa.array(np.zeros(len(texts), bool))
        easy, hard = texts.filter(plain), [self._cut(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
        flat = pa.array([p for pieces in hard for p in pieces], pa.string())
        sizes = np.fromiter(map(len, hard), np.int64, len(hard))
        if not len(easy):
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(easy), SIGNS_ARROW, r"\1 \2\3"))
        if not hard:
            return split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        both = pa.concat_arrays([split, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)])
        here = plain.to_numpy(zero_copy_only=False)
        order = np.where(here, np.cumsum(here) - 1, len(easy) + np.cumsum(~here) - 1)
        both = both.take(pa.array(order))
        return both.flatten(), both.offsets.to_numpy() - both.offsets[0].as_py()

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of the texts, and where each text's begin and end."""
        if self.held > self.kept_bytes:
            self._forget()
        flat, edges = self._pieces(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        of_distinct = hashes(distinct)
        numbers = self._found(distinct, of_distinct)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._add(distinct.take(pa.array(new)), of_distinct[new])
        self.batch += 1
        self.used[numbers] = self.batch
        return numbers[coded.indices.to_numpy()], edges

    def _found(self, pieces: pa.Array, of_pieces: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't kept; a hash only says where to look."""
        numbers = np.full(len(pieces), -1, np.int32)
        if not len(self.hashes):
            return numbers
        at = np.minimum(np.searchsorted(self.hashes, of_pieces), len(self.hashes) - 1)
        likely = np.flatnonzero(self.hashes[at] == of_pieces)
        owners = self.owner[at[likely]]
        same = pc.equal(pieces.take(pa.array(likely)), self.known.take(pa.array(owners))).to_numpy(zero_copy_only=False)
        numbers[likely[same]] = owners[same]
        return numbers

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (strings without nulls)."""
        numbers, edges = self._numbered(texts)
        upto = np.concatenate([[0], np.cumsum(self.sizes[numbers], dtype=np.int64)])
        return upto[edges[1:]] - upto[edges[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each text's."""
        numbers, edges = self._numbered(texts)
        upto = np.concatenate([[0], np.cumsum(self.sizes[numbers], dtype=np.int64)])
        return self._gathered(numbers), upto[edges[1:]] - upto[edges[:-1]]

    def _add(self, pieces: pa.Array, of_pieces: np.ndarray) -> np.ndarray:
        """Keep pieces that are new; their numbers."""
        easy = np.zeros(len(pieces), bool)
        if self.ends is not None:
            easy = pc.and_not(pc.match_substring_regex(pieces, LOWER_ARROW), pc.match_substring_regex(pieces, ODD_ARROW)).to_numpy(zero_copy_only=False)
        texts = pieces.to_pylist()
        order, sizes, ids = [], [], []
        for chosen, found in ((np.flatnonzero(easy), self._words), (np.flatnonzero(~easy), self._joined)):
            for places, n, x in found([texts[k] for k in chosen.tolist()]):
                order.append(chosen[places])
                sizes.append(n)
                ids.append(x)
        order, sizes, ids = np.concatenate(order), np.concatenate(sizes).astype(np.int32), np.concatenate(ids)
        if len(self.pool) + len(ids) >= 1 << 31:
            raise ValueError("a batch has over 2**31 ids of distinct pieces")
        first = len(self.known)
        self.starts = np.concatenate([self.starts, np.int32(len(self.pool)) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.batch + 1, np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        new = pieces.take(pa.array(order))
        self.known = pa.concat_arrays([self.known, new])
        by_hash = np.argsort(of_pieces[order], kind="stable")
        sorted_new = of_pieces[order][by_hash]
        places = np.searchsorted(self.hashes, sorted_new)
        self.hashes, self.owner = np.insert(self.hashes, places, sorted_new), np.insert(self.owner, places, (first + by_hash).astype(np.int32))
        self.held += self._bytes(new, ids)
        numbers = np.empty(len(pieces), np.int32)
        numbers[order] = np.arange(first, first + len(pieces), dtype=np.int32)
        return numbers

    def _words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lower-case words of letters that aren't odd: joined by a space, the ids that end a word tell them apart."""
        groups = [words[k : k + WORDS_JOINED] for k in range(0, len(words), WORDS_JOINED)]
        at = 0
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(group) and (not len(ids) or ends[-1] == len(ids) - 1):
                yield np.arange(at, at + len(group)), np.diff(ends, prepend=-1), ids
            else:
                for places, sizes, some in self._joined(group):
                    yield at + places, sizes, some
            at += len(group)

    def _joined(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, sizes and ids of pieces. The library takes a text apart at special tokens before all else, so pieces joined by one are encoded as if alone."""
        alone = [k for k, p in enumerate(pieces) if self.mark is None or self.mark[1][0] in p]
        others = [k for k, p in enumerate(pieces) if self.mark is not None and self.mark[1][0] not in p]
        groups = [[k] for k in alone] + [others[k : k + JOINED] for k in range(0, len(others), JOINED)]
        texts = [pieces[g[0]] if len(g) == 1 else self.mark[1].join(pieces[k] for k in g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark[0]) if len(group) > 1 else np.zeros(0, np.int64)
            if len(marks) + 1 != len(group):
                raise ValueError("a piece holds the special token that stands between pieces")
            sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            yield np.array(group), sizes, np.delete(ids, marks)


_of_worker: dict[tuple, Pieces] = {}


def worker_pieces(tokenizer_json: str, cut: re.Pattern) -> Pieces:
    """The pieces of this Python worker, which tasks that run in it one after another share."""
    key = (hash(tokenizer_json), cut.pattern)
    if key not in _of_worker:
        _of_worker[key] = Pieces(tokenizer_json, cut)
    return _of_worker[key]


def balanced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each, and one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, n in enumerate(lengths):
            if row > start and held + n > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker waits for other tasks, beside the executor's own memory
