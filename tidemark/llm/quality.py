"""Quality by a generalised additive model with pairwise interactions, boosted cyclically with shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, draw, prepare, share
from tidemark.llm.text import PIECE, Words, blocks, hashed, joined_sum, let_go, pieces

#: Bound of the labelled rows that the model is fitted on.
ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8

NAMES = (
    "log_words", "word_mean", "word_spread", "upper", "digit", "stop", "exclaim", "pipe", "symbol", "newline", "beyond_ascii",
    "repeat_next", "distinct", "distinct_lines", "words_per_stop", "capital_words", "all_upper_words",
)
#: Byte classes: 0 other, 1 upper, 2 lower, 3 digit, 4 full stop or comma, 5 exclamation mark, 6 pipe, 7 symbol, 8 newline, 9 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[46, 44]], _CLASS[33], _CLASS[124] = 1, 2, 3, 4, 5, 6
_CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]] = 7
_CLASS[10], _CLASS[128:] = 8, 9


def features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; all zero for a text without words. A long text is walked in pieces."""
    rows = [_long(texts[a]) if b - a == 1 and len(texts[a]) > 2 * PIECE else _block(texts[a:b]) for a, b in blocks(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


def _sums(w: Words) -> np.ndarray:
    """For each text: bytes by class (10), bytes, words, their length and its square, capitalised words, words in capitals."""
    n = len(w.begins) - 1
    size = np.diff(w.begins)
    kinds = _CLASS[w.raw]
    if n == 1:
        of = np.bincount(kinds, minlength=10).reshape(1, 10)
    else:
        of = np.bincount(np.repeat(np.arange(n), size) * 10 + kinds, minlength=10 * n).reshape(n, 10)
    length = (w.end - w.start).astype(float)
    if len(w.start):
        head, last, middle = (kinds[i] == 1 for i in (w.start, w.end - 1, (w.start + w.end) // 2))
    else:
        head = last = middle = np.zeros(0, bool)
    sum_ = lambda x: np.bincount(w.doc, x, minlength=n)
    return np.column_stack([of, size, np.diff(w.first), sum_(length), sum_(length**2), sum_(head & ~last), sum_(head & middle)]).astype(float)


def _row(sums: np.ndarray, same: np.ndarray, distinct: np.ndarray, lines: np.ndarray, distinct_lines: np.ndarray) -> np.ndarray:
    """Features from the sums of texts, words that repeat the one before, different words, lines and different lines."""
    of, (size, count, length, square, capital, shout) = sums[:, :10], sums[:, 10:].T
    some, solid = np.maximum(count, 1), np.maximum(size, 1)
    mean = length / some
    spread = np.sqrt(np.maximum(square / some - mean**2, 0))
    out = np.column_stack([
        np.log1p(count), mean, spread, of[:, 1] / solid, of[:, 3] / solid, of[:, 4] / some, of[:, 5] / some, of[:, 6] / some, of[:, 7] / some,
        lines / some, of[:, 9] / solid, same / some, distinct / some, distinct_lines / np.maximum(lines, 1),
        count / (of[:, 4] + 1), capital / some, shout / some,
    ])
    out[count == 0] = 0
    return out


def _block(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    w = Words(texts, lower=False)
    same = np.zeros(len(w.hash))
    if len(w.hash) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    # lines: between newlines and texts' ends
    breaks = np.unique(np.concatenate([w.begins, np.flatnonzero(w.raw == 10) + 1]))
    a, b = breaks[:-1], breaks[1:]
    lines = distinct_lines = np.zeros(n)
    if len(a):
        owner = np.searchsorted(w.begins, a, side="right") - 1
        lines = np.bincount(owner, minlength=n)
        key = np.unique(np.stack([owner.astype(np.uint64), w.hash_of(a, np.where(w.raw[b - 1] == 10, b - 1, b))]), axis=1)
        distinct_lines = np.bincount(key[0].astype(np.int64), minlength=n)
    return _row(_sums(w), np.bincount(w.doc, same, minlength=n), np.bincount(d[new], minlength=n), lines, distinct_lines)


def _long(text: bytes) -> np.ndarray:
    sums, same, lines, last = np.zeros((1, 16)), 0, 0, None
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    open_sum, open_size = 0, 0  # the line that the piece before left open
    for _, part in pieces(text):
        w = Words([part], lower=False)
        sums += _sums(w)
        same += int((w.hash[1:] == w.hash[:-1]).sum()) + int(len(w.hash) > 0 and last is not None and w.hash[0] == last)
        last = w.hash[-1] if len(w.hash) else last
        words.append(np.unique(w.hash))
        stops = np.flatnonzero(w.raw == 10)
        a, b = np.append(0, stops + 1), np.append(stops, len(w.raw))
        own, size = w.sum_of(a, b), b - a
        own[0], size[0] = joined_sum(open_sum, open_size, int(own[0])), size[0] + open_size
        lines += len(stops)
        marks.append(np.unique(hashed(own[:-1], size[:-1])))
        open_sum, open_size = int(own[-1]), int(size[-1])
    if open_size:
        lines += 1
        marks.append(hashed(np.array([open_sum], np.uint64), np.array([open_size])))
    different = [np.array([len(np.unique(np.concatenate(x)))]) for x in (words, marks)]
    return _row(sums, np.array([same]), different[0], np.array([lines]), different[1])


@dataclass
class Model:
    """log-odds = bias + a table entry for each feature's bin + one for each pair's cell."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for i, j, t in self.pairs:
                z += t[c[i], c[j]]
        return z

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features(texts)), -50, 50)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.empty(0)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of a run of bins with gradient and curvature sums g and h."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """The step of a tree of that depth over bins in a row, as a value for each bin."""
    gain, k = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([_shallow(g[:k], h[:k], ridge, depth - 1), _shallow(g[k:], h[k:], ridge, depth - 1)])


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that splits a grid by one axis, then each half by the other."""
    best, out = -1.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + ridge)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        _, k = _best_cut(a.sum(1), b.sum(1), ridge)
        value, total = np.zeros_like(a), 0.0
        for part in (slice(0, k), slice(k, None)):
            if not a[part].size:
                continue
            step = _shallow(a[part].sum(0), b[part].sum(0), ridge, 1)
            value[part] = step
            total += sum(a[part][:, step == s].sum() ** 2 / (b[part][:, step == s].sum() + ridge) for s in np.unique(step))
        if total - base > best:
            best, out = total - base, value.T if flip else value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Boosts each feature's table in turn, round after round; then, tables fixed, the PAIRS pairs that explain most of what is left."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(float(np.log(p / (1 - p))))
    p = y.mean()
    k = x.shape[1]
    model = Model(float(np.log(p / (1 - p))), [_cuts(x[:, j], BINS) for j in range(k)], [], [_cuts(x[:, j], PAIR_BINS) for j in range(k)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _shallow(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n), ridge)
            model.tables[j] += step
            z += step[binned[j]]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(cell[i] * b + cell[j], v, a * b).reshape(a, b)

    g, h = slopes()
    gains = sorted(((-_quarters(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(k) for j in range(i)))[:PAIRS]
    chosen = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in gains]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            g, h = slopes()
            step = rate * _quarters(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += step
            z += step[cell[i], cell[j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = ROWS, seed: int = 2) -> Model:
    """Fits on at most about rows labelled texts, drawn by id; learn says which ids may teach.

    Only the features of those texts come to the driver. Rows of labels with a null id or null quality teach nothing;
    a null text teaches as an empty one; an id that labels repeats, or docs, teaches once for each different label and row.
    Only doc_id, text and quality are read, whatever other columns are there.
    """
    prepare(docs.sparkSession)
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = known.where(draw("doc_id", seed) < share(rows, known.count())).limit(2 * rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    got = sorted((r["quality"], tuple(r["x"])) for r in picked.mapInArrow(run, "quality int, x array<double>").toLocalIterator())
    x = np.array([g[1] for g in got], float).reshape(-1, len(NAMES))
    return fit(x, np.array([g[0] == 1 for g in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs, repeated rows each; null text scores as empty text.

    Whole texts are scored, long ones piece by piece; other columns are ignored. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])
        let_go()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double")


def may_teach(modulus: int = 4, held: int = 2):
    return crc_mod("doc_id", modulus) != held
