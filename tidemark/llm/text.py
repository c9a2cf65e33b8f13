"""Vectorised words, word hashes and shingles over blocks of texts."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space (fixed values): space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Letters by byte: A-Z, a-z and every byte of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True

_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}
_BITS = 21
_STEP = 1 << _BITS
#: Bytes that a block of texts or a piece of a long text has about.
PIECE = 1 << 19


def _table(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(1 << 12, 1 << int(n - 1).bit_length()), base, np.uint64)
        t[0] = 1
        _tables[base] = t = np.multiply.accumulate(t)
    return t


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2 ** 64, from tables of at most _STEP entries whatever the exponents."""
    top = int(at.max(initial=0))
    if top < _STEP:
        return _table(base, top + 1)[at]
    return _table(base, _STEP)[at & (_STEP - 1)] * _table(pow(base, _STEP, 1 << 64), (top >> _BITS) + 1)[at >> _BITS]


def running(data: np.ndarray, base: int) -> np.ndarray:
    """The sums of data[i] * base ** i over i below 0, 1, ... len(data), modulo 2 ** 64, for up to _STEP numbers."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * _table(base, len(data) + 1)[: len(data)])])


def sums(data: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """running(data, base)[at] for data of any length, slice by slice; at rises."""
    out = np.zeros(len(at), np.uint64)
    low, total = 0, 0
    for s in range(0, len(data), _STEP):
        run = running(data[s : s + _STEP], base) * np.uint64(pow(base, s, 1 << 64)) + np.uint64(total)
        high = np.searchsorted(at, s + len(run) - 1, side="right")
        out[low:high] = run[at[low:high] - s]
        low, total = high, int(run[-1])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a block of texts with A-Z in lower case.

    raw: the bytes; start, end: byte ranges in raw; doc: the text of each word; begins: first byte of each text;
    first: first word of each text, and their number at the end; hash: 64 bits of each word. With letters, words are
    runs of letters instead.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, letters: bool = False):
        self.raw = np.frombuffer(texts[0] if len(texts) == 1 else b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.raw)
        solid = _LETTER[self.raw] if letters else ~_SPACE[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.begins] = True  # a text's end parts words too
        before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if n else solid
        after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if n else solid
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._data = (_LOWER[self.raw] if lower else self.raw) + np.uint8(1)
        self._total = running(self._data, _P) if n <= _STEP else None
        self.hash = self.hash_of(self.start, self.end)

    def sum_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What hash_of() spreads: sums by place in the range, so that the sum of a range is that of its parts, moved."""
        if self._total is not None:
            own = self._total[end] - self._total[start]
        else:
            own = sums(self._data, _P, end) - sums(self._data, _P, start)
        return own * power(_PINV, start)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of each byte range, by content alone. Starts and ends rise."""
        return hashed(self.sum_of(start, end), end - start)


def hashed(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def joined_sum(left: int, size: int, right: int) -> int:
    """The sum of a range whose first size bytes have the sum left and whose others have the sum right."""
    return (left + right * pow(_P, size, 1 << 64)) % (1 << 64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out += h[k : k + len(out)] * np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64))
    return mix(out)


def _whole(h: np.ndarray) -> np.ndarray:
    total = np.sum(h * power(0xE7037ED1A0B428DB, np.arange(1, len(h) + 1)))
    return mix(np.array([total], np.uint64)) ^ np.uint64(len(h))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of size words; a text with fewer words, but some, has its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    whole = words.doc[: n - size + 1] == words.doc[size - 1 :] if n >= size else np.zeros(0, bool)
    doc, out = words.doc[: len(whole)][whole], _rolled(h, size)[whole]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        few = [_whole(h[words.first[d] : words.first[d + 1]]) for d in short]
        doc, out = np.concatenate([doc, short]), np.concatenate([out, *few])
    return doc, out


def pieces(text: bytes, limit: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(place, part) of a text, in parts of about limit bytes that end behind white space: no part cuts a word."""
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text):
            near = [m.end() for m in [_GAP.search(text, end)] if m]
            end = near[0] if near else len(text)
        yield at, text[at:end]
        at = end


def _long_set(text: bytes, size: int) -> np.ndarray:
    found, held, short = np.zeros(0, np.uint64), np.zeros(0, np.uint64), True
    parts: list[np.ndarray] = []
    for _, part in pieces(text):
        held = np.concatenate([held, Words([part]).hash])
        if len(held) >= size:
            parts.append(np.unique(_rolled(held, size)))
            held, short = held[len(held) - size + 1 :], False
    if parts:
        found = np.unique(np.concatenate(parts))
    return _whole(held) if short and len(held) else found


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A long text is walked in pieces."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        if b - a == 1 and len(texts[a]) > 2 * PIECE:
            out.append(_long_set(texts[a], size))
            continue
        words = Words(texts[a:b])
        doc, hashes = shingle_hashes(words, size)
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(b - a + 1))
        hashes = hashes[order]
        out += [np.unique(hashes[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return out


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed longs; (0, 0) for the empty set."""
    one = np.sum(mix(hashes ^ np.uint64(0x8EBC6AF09C88C6E3)), dtype=np.uint64)
    two = np.sum(mix(hashes * np.uint64(0x589965CC75374CC3) + np.uint64(1)), dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def let_go() -> None:
    """Gives memory that this worker needn't keep back to the machine: workers stay alive between stages."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
