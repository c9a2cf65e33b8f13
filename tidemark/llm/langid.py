"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, cut, draw, drop_cut, prepare
from tidemark.llm.text import PIECE, blocks

#: Bound of the texts per language that centroids are fitted on, centroids per language, and hashed n-gram dimensions.
PER_LANGUAGE, CENTROIDS, BITS = 400, 4, 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.ones(256, bool)  # bytes that n-grams skip: digits, punctuation and control signs count as one blank
_PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = False
_LOWER[_PLAIN] = 32


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte 1- to 3-grams of each text, A-Z lowered, what isn't a letter as blank, as float32 rows."""
    dim = 1 << BITS
    shift = np.uint32(32 - BITS)
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        row = np.zeros(dim, np.int64)
        for s in range(0, len(t), PIECE):
            # a piece sees the two bytes before it, and counts what ends in it
            head = min(2, s)
            b = _LOWER[np.frombuffer(t, np.uint8, min(PIECE, len(t) - s) + head, s - head)].astype(np.uint32)
            two = b[:-1] * np.uint32(256) + b[1:]
            three = two[:-1] * np.uint32(256) + b[2:]
            b, two = b[head:], two[max(0, head - 1) :]
            two, three = two[(two != 0x2020)], three[(three & 0xFFFF) != 0x2020]
            row[:256] += np.bincount(b[b != 32], minlength=256)
            row += np.bincount((two + np.uint32(1 << 24)) * np.uint32(2654435761) >> shift, minlength=dim)
            row += np.bincount((three + np.uint32(1 << 25)) * np.uint32(2654435761) >> shift, minlength=dim)
        out[i] = row
    return out


@dataclass
class Model:
    """Centroids (rows of length 1) with the language and the rejection distance of each."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray

    def nearest(self, texts: list[bytes]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cosine cut to 0..1 and whether the text is farther off than the centroid's own texts ever were."""
        names: list[str | None] = []
        cos, far = np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return [None] * len(texts), cos, far
        for a, b in blocks(texts, 1 << 21):
            for x in range(a, b, 512):
                y = min(x + 512, b)
                near = unit_rows(counts(texts[x:y]), self.idf) @ self.centroids.T
                best = near.argmax(1)
                cos[x:y] = np.clip(near[np.arange(y - x), best], 0, 1)
                far[x:y] = 1 - cos[x:y] > self.reach[best]
                names += [self.languages[self.owner[k]] for k in best]
        return names, cos, far


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: centroids and the owner of each row."""
    centre = v.mean(0)
    start = [int(np.argmax(v @ centre))]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin((v @ v[start].T).max(1))))
    c = v[start]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).argmax(1)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, of n texts."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def unit_rows(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def fit_one(c: np.ndarray, idf: np.ndarray, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """A language's centroids and the rejection distance of each, from the counts of its texts."""
    v = unit_rows(c, idf)
    cs, of = _clusters(v, centroids)
    gaps = [1 - v[of == j] @ cs[j] for j in range(len(cs))]
    return cs.astype(np.float32), np.array([float(g.mean() + 4 * g.std() + 0.02) if len(g) else 0.0 for g in gaps])


def _packed(c: np.ndarray) -> list[bytes]:
    return [r.astype(np.uint16).tobytes() if r.max(initial=0) < 65536 else np.log1p(r).tobytes() for r in c]


def _unpacked(data: list[bytes]) -> np.ndarray:
    wide = 2 << BITS
    return np.stack([np.frombuffer(d, np.uint16).astype(np.float32) if len(d) == wide else np.expm1(np.frombuffer(d, np.float32)) for d in data])


def train(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, seed: int = 6) -> Model:
    """Fits on about per_language texts of each language, drawn by id; learn says which ids may teach.

    Every language is learned, however many there are, each in a task of its own; the driver holds the model, which is
    centroids * 2 ** BITS numbers a language, and the table of languages that is broadcast is far smaller than that.
    Null lang, null text and texts without a letter teach nothing; rows that repeat an id are drawn together.
    """
    prepare(docs.sparkSession)
    known = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    part = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("part"))
    picked = known.where(has_letter()).join(F.broadcast(part), "lang").where(draw("doc_id", seed) < F.col("part")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = counts(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(c), pa.binary())], names=["lang", "data"])

    vectors = cut(picked.mapInArrow(count, "lang string, data binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                df += (_unpacked(batch.column(0).to_pylist()) > 0).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    n, df = 0, np.zeros(1 << BITS, np.int64)
    for r in vectors.select("data").mapInArrow(frequencies, "n long, df binary").toLocalIterator():
        n, df = n + r["n"], df + np.frombuffer(r["df"], np.int64)
    idf = weights(df, n)

    def cluster(table: pa.Table) -> pa.Table:
        cs, reach = fit_one(_unpacked(sorted(table.column("data").to_pylist())), idf, centroids)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": [lang], "k": pa.array([len(cs)]), "centroids": pa.array([cs.tobytes()], pa.binary()), "reach": pa.array([reach.tobytes()], pa.binary())})

    fitted = vectors.groupBy("lang").applyInArrow(cluster, "lang string, k long, centroids binary, reach binary")
    rows = sorted((r["lang"], bytes(r["centroids"]), bytes(r["reach"])) for r in fitted.toLocalIterator())
    drop_cut(vectors)
    if not rows:
        return Model([], idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros(0))
    reach = [np.frombuffer(r, np.float64) for _, _, r in rows]
    every = np.concatenate([np.frombuffer(c, np.float32).reshape(-1, 1 << BITS) for _, c, _ in rows])
    return Model([lang for lang, _, _ in rows], idf, every, np.repeat(np.arange(len(rows)), [len(r) for r in reach]), np.concatenate(reach))


def has_letter():
    return F.col("text").rlike(r"\p{L}")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs.

    lang_pred is the language of the nearest centroid and score the cosine to it, from 0 to 1; rejected says that it is
    farther off than the centroid's rejection distance, in which case a caller may want und. Null text and text without
    a letter get und, score 0 and are rejected, and so does everything if no language was learned. Ties go to the
    language that comes first by name; rows that repeat are told each, whole texts are read, long ones in pieces, other
    columns are ignored, and an empty table gives an empty one.
    """
    lettered = F.coalesce(has_letter(), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            names, cos, far = model.nearest(texts)
            some = batch.column(1).to_pylist()
            names = [n if s and n is not None else "und" for n, s in zip(names, some, strict=True)]
            known = np.array([n != "und" or bool(s and model.languages) for n, s in zip(names, some, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, cos, 0.0)), pa.array(far | ~known)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("some"), F.when(lettered, F.col("text")).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def may_teach(modulus: int = 3, held: int = 1):
    return crc_mod("doc_id", modulus) != held
