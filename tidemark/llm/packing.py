"""Packing tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import let_go

CAPACITY = 2048
#: Words kept with their ids by one Python worker; beyond that new words are encoded each time.
KEPT_WORDS = 300_000
#: One run of letters that normalising only lower-cases, then perhaps one run of plain punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$&*#|]*)")
_SPACES = "\t\n\x0b\x0c\r"
#: Characters that are encoded at once.
_PIECE = 1 << 20
#: The normaliser and splitter of the tokenizer file whose ids are those of its words, one by one (fixed values).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LETTERS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Windows that may be open: some, and one for so many that are full.
OPEN, OPEN_SHARE = 2048, 16


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 onwards in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(text): the ids that the tokenizer file gives, as numpy uint32.

    If the file lower-cases and drops white space as word_bpe_49k.json does, nothing joins what white space parts, so
    ids are those of the pieces between spaces, one after another. A piece of plain letters goes straight to the
    file's BPE model; any other goes through the whole tokenizer. Pieces and their ids are kept, up to KEPT_WORDS.
    With any other normaliser or splitter the whole text goes through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        normal, split = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
        self.by_word = normal.get("normalizers") == _NORMALIZERS and split.get("pretokenizers") == [_SPLIT, _LETTERS]
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]

    def _whole(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _run(self, part: str, how: Callable[[str], list[int]]) -> bytes:
        ids = self.kept.get(part)
        return np.asarray(how(part), "<u4").tobytes() if ids is None else ids

    def _piece(self, piece: str) -> bytes:
        m = _PLAIN.fullmatch(piece)
        if not m:
            ids = self._run(piece, self._whole)
        else:
            word = m[1].lower()
            ids = self._keep(word, self._run(word, self._model))
            if m[2]:
                ids += self._keep(m[2], self._run(m[2], self._whole))
        return self._keep(piece, ids)

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self.kept) < KEPT_WORDS and len(piece) < 64:
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.asarray(self._whole(text), "<u4")
        for space in _SPACES:
            if space in text:
                text = text.replace(space, " ")
        get, slow = self.kept.get, self._piece
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + _PIECE) if at + _PIECE < len(text) else -1
            end = len(text) if end < 0 else end
            out.append(b"".join([get(x) or slow(x) for x in filter(None, text[at:end].split(" "))]))
            at = end
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: How a piece came to its window.
FULL, PLACED, SPLIT, SEALED = "full", "placed", "split", "sealed"
_NEVER = np.iinfo(np.int64).max


class SumOfSquares:
    """Open windows by fill level; place() puts a piece where the sum of squared counts of partly filled windows is least.

    count[h] is the number of open windows filled to h. Moving one of them from h to h + n changes the sum by
    2 * (count[h + n] - count[h]) + 2, filling it up by 1 - 2 * count[h], and opening a window by 2 * count[n] + 1.
    Ties go to the fullest level. A piece is (key, start, ids, total, how).
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def _best(self, n: int) -> tuple[int, int]:
        """(change, level) of the open window that takes n tokens best; level 0 if there is none."""
        c = self.capacity
        here, there = self.count[1 : c - n + 1], self.count[1 + n : c + 1]
        if not len(here):
            return _NEVER, 0
        change = 2 * (there - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = _NEVER
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return (int(change[best]), best + 1) if here[best] else (_NEVER, 0)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, window: list, level: int) -> list[list]:
        if level == self.capacity:
            return [window]
        self.count[level] += 1
        self.open += 1
        self.windows[level].append(window)
        return []

    def place(self, piece: tuple, limit: float = float("inf")) -> list[list]:
        """Windows, as lists of pieces, that are full now.

        With limit windows open already no other is opened: a piece that none of them takes whole is cut at the end of
        one, that with the least sum when it is full, the emptiest of such; what is left is placed again.
        """
        key, start, ids, total, how = piece
        n, c = len(ids), self.capacity
        if n == c:
            return [[piece]]
        change, level = self._best(n)
        if change > 2 * self.count[n] + 1 and self.open < limit:
            return self._put([piece], n)
        if level:
            window = self._take(level)
            window.append(piece)
            return self._put(window, level + n)
        if not self.open:
            return self._put([piece], n)
        level = int(np.argmax(self.count[1:c])) + 1
        window = self._take(level)
        room = c - level
        window.append((key, start, ids[:room], total, SPLIT))
        return [window, *self.place((key, start + room, ids[room:], total, SPLIT), limit)]

    def drain(self) -> Iterator[list]:
        """Empties the emptiest window and places its pieces in the others, again and again; at most one is left open."""
        while self.open > 1:
            window = self._take(int(np.flatnonzero(self.count)[0]))
            for piece in sorted(window, key=lambda p: -len(p[2])):
                yield from self.place(piece, 0)

    def last(self) -> list:
        return self._take(int(np.flatnonzero(self.count)[0])) if self.open else []


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_ids(docs: Iterator[tuple[object, np.ndarray]], capacity: int = CAPACITY) -> Iterator[list[tuple]]:
    """Windows as lists of (key, start, ids, doc_tokens, how), of documents (key, ids) in any number.

    A document longer than a window gives full windows and a remainder; remainders are placed by SumOfSquares, which
    may hold OPEN windows open and one more for every OPEN_SHARE full ones. At the end the emptiest windows are emptied
    and their pieces placed by the same rule, cut where no other window takes them whole. The one window that is left is
    cut into windows whose lengths are powers of two, which need no padding. how says how a piece came where it is.
    """
    levels = SumOfSquares(capacity)
    full = 0
    for key, ids in docs:
        total = len(ids)
        whole = total // capacity * capacity
        for start in range(0, whole, capacity):
            yield [(key, start, ids[start : start + capacity], total, FULL)]
        if total > whole:
            for window in levels.place((key, whole, ids[whole:].copy(), total, PLACED), OPEN + full // OPEN_SHARE):
                full += 1
                yield window
    yield from levels.drain()
    left = levels.last()
    sizes = powers(sum(len(p[2]) for p in left))
    window: list[tuple] = []
    room = sizes.pop(0) if sizes else 0
    for key, start, ids, total, _ in left:
        while len(ids):
            now = ids[:room]
            window.append((key, start, now, total, SEALED))
            start, ids, room = start + len(now), ids[len(now) :], room - len(now)
            if not room:
                yield window
                window, room = [], sizes.pop(0) if sizes else 0


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("how", pa.string())]
)
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, how string"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, how.

    docs: doc_id and text, other columns are ignored. A document is the ids of its whole text and end_id; null and
    empty text is end_id alone. Every row of docs is a document of its own, repeated ids and null ids too. Each
    partition is packed in one pass and keeps only the windows that are still open, by level; nothing is shuffled.
    sequence_id holds the partition's number above 40 bits, so a task that runs again gives the same rows. how is full
    for a window's worth of a long document, placed for what the rule placed whole, split for what it cut where no open
    window had room, and sealed for the partition's last window. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4")

        def ids() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, np.concatenate([enc.encode(text.as_py() or ""), end])

        rows: list[tuple] = []
        size = 0
        base = TaskContext.get().partitionId() << 40
        for number, window in enumerate(pack_ids(ids(), capacity)):
            at = 0
            for key, start, part, total, how in window:
                rows.append((key, start, len(part), part.tobytes(), total, base + number, at, how))
                at += len(part)
            size += at
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
        rows = []
        let_go()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, DDL)
