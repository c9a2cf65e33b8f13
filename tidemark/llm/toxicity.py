"""Toxicity by non-negative positive-unlabelled learning.

Learns from confirmed toxic texts and unlabelled ones; labels that say "not toxic" are not used. Features are words of
letters and their first bytes. Before learning, features that aren't surely more frequent in positives are left out; the
risk estimator then weighs those that are left, some below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, draw, prepare, share
from tidemark.llm.text import PIECE, Words, blocks, let_go, pieces

#: Bounds of the sample that the classifier is fitted on: confirmed toxic texts, and unlabelled texts.
POSITIVES, UNLABELLED = 4000, 8000
#: Features that the classifier may keep.
FEATURES = 20_000
#: Standard errors by which a feature must be more frequent in positives than unlabelled text lets expect.
SURE = 5.0
_PREFIX = 5
_SALT = np.uint64(0x5851F42D4C957F2D)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the block's words of letters and of their first bytes; repeats are left in."""
    w = Words(texts, letters=True)
    size = w.end - w.start
    long = size > _PREFIX
    head = w.hash_of(w.start[long], w.start[long] + _PREFIX) ^ _SALT
    return np.concatenate([w.doc, w.doc[long]]), (np.concatenate([w.hash, head]) >> np.uint64(32)).astype(np.uint32)


def _pairs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text from there, feature) of blocks; a long text comes in several, a piece each."""
    for a, b in blocks(texts):
        if b - a == 1 and len(texts[a]) > 2 * PIECE:
            for _, part in pieces(texts[a]):
                yield a, *_features([part])
        else:
            yield a, *_features(texts[a:b])


def feature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The features of each text, sorted, each once."""
    out: dict[int, np.ndarray] = {}
    for a, doc, f in _pairs(texts):
        key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | f)
        doc = (key >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
        for x, y in zip(at, [*at[1:], len(key)], strict=False):
            i, own = a + int(doc[x]), key[x:y].astype(np.uint32)
            out[i] = np.union1d(out[i], own) if i in out else own
    return [out.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]


@dataclass
class Model:
    """score = sigmoid(bias + the weights of the features that a text has)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        n = len(self.features)
        if n:
            found = [np.zeros(0, np.int64)]
            for a, doc, f in _pairs(texts):
                at = np.minimum(np.searchsorted(self.features, f), n - 1)
                hit = self.features[at] == f
                found.append(np.unique((a + doc[hit]) * n + at[hit]))
            key = np.unique(np.concatenate(found))
            out += np.bincount(key // n, self.weights[key % n], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _once(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [np.frombuffer(d, np.uint32) for d in sorted({x.tobytes() for x in sets})]


def _telling(in_p: np.ndarray, in_u: np.ndarray, np_: int, nu: int, least: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Features surely more frequent in positives than in unlabelled text, by SURE standard errors, and all ratios."""
    ratio = (in_p + 0.5) / np_ / ((in_u + 0.5) / nu)
    expected = (in_u + 0.5) / nu * np_
    return np.flatnonzero((in_p - expected >= SURE * np.sqrt(expected + 1)) & (ratio >= least)), ratio


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 0.3) -> float:
    """The share of positives in unlabelled text, from feature sets alone.

    Of all rules, the share of unlabelled texts that one catches is at least the prior times the share of positives that
    it catches; so the prior is at most the least quotient of the two. The rules are the cuts of a sum of log ratios,
    learned on one half of the texts and judged on the other, that catch least or more of the positives there; an upper
    bound of each unlabelled share is taken. Where no rule tells the two apart by a factor of two, the confirmed
    positives' own share of the texts is returned: toxic text is taken to be the lesser part.
    """
    positive, unlabelled = _once(positive), _once(unlabelled)
    known = {x.tobytes() for x in positive}
    floor = sum(x.tobytes() in known for x in unlabelled) / max(1, len(unlabelled))
    floor = max(floor, 1.0 / (len(unlabelled) + 1))
    bounds = []
    for fold in (0, 1):
        p, u = positive[fold::2], unlabelled[fold::2]
        q, v = positive[1 - fold :: 2], unlabelled[1 - fold :: 2]
        if not (len(p) and len(u) and len(q) and len(v)):
            continue
        name, at = np.unique(np.concatenate([*p, *u]), return_inverse=True)
        mine = np.arange(len(at)) < sum(map(len, p))
        in_p, in_u = (np.bincount(at[m], minlength=len(name)) for m in (mine, ~mine))
        good, ratio = _telling(in_p, in_u, len(p), len(u), 1.5)
        weight = dict(zip(name[good].tolist(), np.log(ratio[good]).tolist(), strict=True))
        marks = lambda sets: np.array([sum(weight.get(f, 0.0) for f in s.tolist()) for s in sets])
        sp, su = np.sort(marks(q)), np.sort(marks(v))
        for cut in np.unique(sp[sp > 0]):
            caught = len(sp) - np.searchsorted(sp, cut)
            if caught >= least * len(sp):
                also = len(su) - np.searchsorted(su, cut)
                bounds.append((also + np.sqrt(also + 1)) / len(su) / (caught / len(sp)))
    best = min(bounds, default=1.0)
    return float(min(max(best, floor), 0.9)) if best < 0.5 else float(floor)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 1000, rate: float = 0.05, decay: float = 2e-5) -> Model:
    """A linear classifier that minimises the class-prior-corrected risk, its negative part held at zero.

    risk = prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)]), with the logistic
    loss. Where the bracket falls under zero, a step up its gradient undoes the overfit. Features are those that
    are three times as frequent in positives as in unlabelled text, and more frequent than that by SURE standard
    errors. Texts with the same features count once, so that copies don't make their words telling.
    """
    prior = float(np.clip(prior, 1e-4, 0.9))
    positive, unlabelled = _once(positive), _once(unlabelled)
    if not positive or not unlabelled:
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(prior / (1 - prior))))
    name, inverse = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    np_, nu = len(positive), len(unlabelled)
    rows = np.repeat(np.arange(np_ + nu), [len(x) for x in (*positive, *unlabelled)])
    in_p = np.bincount(inverse[rows < np_], minlength=len(name))
    in_u = np.bincount(inverse[rows >= np_], minlength=len(name))
    good, ratio = _telling(in_p, in_u, np_, nu, min(3.0, 0.5 / prior))
    good = np.sort(good[np.argsort(-ratio[good] * np.sqrt(in_p[good]), kind="stable")[:FEATURES]])
    column = np.full(len(name), -1)
    column[good] = np.arange(len(good))
    col = column[inverse]
    rows, col = rows[col >= 0], col[col >= 0]
    k = len(good)
    w, bias = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    is_p = np.arange(np_ + nu) < np_
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[col], minlength=np_ + nu) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        minus = np.logaddexp(0, z)  # loss of saying "clean", its slope in z is p
        bracket = minus[~is_p].mean() - prior * minus[is_p].mean()
        low = np.where(is_p, -prior * p / np_, p / nu)
        slope = low + np.where(is_p, -prior * (1 - p) / np_, 0) if bracket >= 0 else -low
        g = np.append(np.bincount(col, slope[rows], minlength=k) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(name[good], w, float(bias))


def train(docs: DataFrame, labels: DataFrame, learn, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 4, prior: float | None = None) -> Model:
    """Fits on a sample of at most about positives + unlabelled texts, drawn by id; learn says which ids may teach.

    Positives are the ids that some row of labels marks toxic = 1; no other label is read. Unlabelled texts come from
    all documents that may teach. prior, the share of toxic texts among those, is estimated where it isn't given. Rows
    of labels with a null id, and null texts, teach nothing; an id that labels repeats is one positive. Without
    positives the model says its prior for every text. Only doc_id, toxic and text are read.
    """
    prepare(docs.sparkSession)
    known = labels.where(learn & F.col("doc_id").isNotNull() & (F.col("toxic") == 1)).select(F.col("doc_id").alias("known")).distinct()
    toxic = known.count()
    teach = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text")
    there = docs.select("doc_id").where(learn).count()
    chosen = known.where(draw("known", seed) < share(positives, toxic)).limit(2 * positives)
    picked = teach.join(F.broadcast(chosen), F.col("doc_id") == F.col("known"), "left")
    other = draw("doc_id", seed + 1) < share(unlabelled, there)
    picked = picked.select(F.col("known").isNotNull().alias("toxic"), other.alias("other"), "text").where("toxic or other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = feature_sets(batch.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["toxic", "other", "data"])

    got = sorted((r["toxic"], r["other"], bytes(r["data"])) for r in picked.mapInArrow(run, "toxic boolean, other boolean, data binary").toLocalIterator())
    arrays = [(t, o, np.frombuffer(d, np.uint32)) for t, o, d in got]
    p, u = [a for t, _, a in arrays if t], [a for _, o, a in arrays if o]
    return fit(p, u, estimate_prior(p, u) if prior is None else prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs, repeated rows each; null text scores as empty text, which has no feature.

    Whole texts are scored, long ones piece by piece; other columns are ignored. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])
        let_go()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs whose score is under the threshold, columns as they are and whatever their names; rows that repeat fare alike."""

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        out = pa.array(model.score([t or b"" for t in text.cast(pa.binary()).to_pylist()]), pa.float64())
        let_go()
        return out

    return docs.where(toxic("text") < threshold)


def may_teach(modulus: int = 5, held: int = 0):
    return crc_mod("doc_id", modulus) != held
