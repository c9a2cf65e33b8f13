"""Substring deduplication by content-defined chunks with a gear rolling hash.

Texts are cut at words whose gear hash, over the bytes before the word's end, has some bits clear; a chunk so depends on
its content alone, and an insertion shifts nothing behind the next cut. Chunks are known by a 64-bit digest of their
words. The first chunk of a digest, by document id and place, stays; later ones are repeats, and a run of repeats of
MIN_RUN words or more is taken out of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import deal, even_keys, fields, partitions, power_of_two, prepare, row_of
from tidemark.llm.text import PIECE, Words, blocks, let_go, mix, pieces, power, running, sums

#: A cut may follow one word in 2 ** CUT_BITS; a chunk has MIN_WORDS to MAX_WORDS words, the last of a text perhaps fewer.
CUT_BITS, MIN_WORDS, MAX_WORDS = 2, 3, 16
#: Words that a run of repeated chunks must have to be removed: what is left of 50 words when both ends fall inside chunks.
MIN_RUN = 16
#: Bytes that the gear hash looks back.
WINDOW = 16
#: Chunks that one block of documents holds before it is sent out.
BLOCK_CHUNKS = 250_000
#: Bytes of text whose chunks one fragment should compare: it is one group in one worker. There are as many as that takes.
FRAGMENT_BYTES = 96 << 20

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_GEAR[0] = 0
_BACK = np.arange(1, WINDOW + 1, dtype=np.int32)
_Q = 0xD1342543DE82EF95
_QINV = pow(_Q, -1, 1 << 64)
_ENTRY = np.dtype([("digest", "<u8"), ("id", "<i8"), ("place", "<u4"), ("tag", "<u4")])
_PLACE = np.dtype([("id", "<i8"), ("place", "<u4"), ("tag", "<u4")])
_NO_ID = np.iinfo(np.int64).max


def gear(data: np.ndarray, end: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """At each end the sum of gear values of the WINDOW bytes before it, but not before begin, each shifted left by its
    distance."""
    at = end.astype(np.int32)[:, None] - _BACK
    value = _GEAR[data[np.maximum(at, 0)]] << (_BACK - 1).astype(np.uint32)
    value[at < begin.astype(np.int32)[:, None]] = 0
    return value.sum(1, dtype=np.uint32)


def chunk_ends(words: Words, before: bytes = b"", closed: bool = True) -> np.ndarray:
    """The word after each chunk's last, for all texts of the block; no chunk spans two texts.

    before: what stands before the first text, which the gear hash sees. Unless closed, texts go on, and so may their
    last chunk, which is left out.
    """
    n = len(words.begins) - 1
    before = before[-WINDOW:]
    plain = np.concatenate([np.frombuffer(before, np.uint8), words.raw])
    plain = np.where((plain >= 0x09) & (plain <= 0x0D), np.uint8(0x20), plain)
    plain += ((plain >= 65) & (plain <= 90)).astype(np.uint8) * np.uint8(32)
    begin = words.begins[:-1] + len(before)
    begin[:1] = 0
    at = gear(plain, words.end + len(before), begin[words.doc])
    may = np.flatnonzero((at >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1) == 0).tolist()
    may.append(len(words.start))
    first = words.first.tolist()
    ends: list[int] = []
    k = 0
    for d in range(n):
        last, stop = first[d], first[d + 1]
        while last < stop:
            inside = may[k] < stop
            end = may[k] + 1 if inside else stop
            if inside:
                k += 1
            while end - last > MAX_WORDS:
                last += MAX_WORDS
                ends.append(last)
            if not inside and not closed:
                break
            if end - last >= MIN_WORDS or end == stop and end > last and closed:
                ends.append(end)
                last = end
            elif end == stop:
                break
    return np.array(ends, np.int64)


def _digests(words: Words, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    total = running(words.hash, _Q) if len(words.hash) < 1 << 20 else None
    at = (lambda i: total[i]) if total is not None else (lambda i: sums(words.hash, _Q, i))
    digest = mix((at(ends) - at(starts)) * power(_QINV, starts) + (ends - starts).astype(np.uint64))
    return starts, ends, digest


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, digest) of each chunk of the block."""
    return _digests(words, chunk_ends(words))


def long_chunks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, byte where the next chunk's first word or the text's end stands, words, digest) of the chunks of one
    text, a piece at a time; what follows a piece's last whole chunk goes to the next piece."""
    held = 0
    for at, part in pieces(text):
        end = at + len(part)
        words = Words([text[held:end]])
        starts, ends, digest = _digests(words, chunk_ends(words, text[max(0, held - WINDOW) : held], closed=end == len(text)))
        if len(ends):
            stop = np.append(words.start, len(words.raw))
            yield words.start[starts] + held, stop[ends] + held, ends - starts, digest
            held += int(stop[ends[-1]])


def text_chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What long_chunks() gives, of all pieces."""
    parts = list(long_chunks(text))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _send(docs: DataFrame, keys: list[int] | range) -> DataFrame:
    """(frag, kind, data). kind 0: a block's first chunk of each digest; kind 1: its other chunks, repeats for sure.

    So that a digest of which there are very many counts once a block where it is compared with other blocks.
    """
    bits = len(keys).bit_length() - 1

    def flush(entries: list[np.ndarray], number: int) -> pa.RecordBatch:
        every = np.concatenate(entries)
        every = every[np.lexsort((every["tag"], every["place"], every["id"], every["digest"]))]
        new = np.concatenate([[True], every["digest"][1:] != every["digest"][:-1]])
        same = np.concatenate([[False], ~new[1:] & (every["id"][1:] == every["id"][:-1]) & (every["place"][1:] == every["place"][:-1]) & (every["tag"][1:] == every["tag"][:-1])])
        lead = np.maximum.accumulate(np.where(~same, np.arange(len(every)), 0))
        first, later = every[new], every[~new & ~new[lead]]
        frag = first["digest"] >> np.uint64(64 - bits) if bits else np.zeros(len(first), np.uint64)
        frags, at = np.unique(frag, return_index=True)  # the digests are in order, and so are the fragments
        rows = [(keys[int(f)], 0, first[a:b].tobytes()) for f, a, b in zip(frags, at, [*at[1:], len(first)], strict=True)]
        if len(later):
            places = np.empty(len(later), _PLACE)
            for c in _PLACE.names:
                places[c] = later[c]
            rows.append((keys[number % len(keys)], 1, places.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["frag", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * 7919
        entries: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            tags = batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in blocks(texts):
                if b - a == 1 and len(texts[a]) > 2 * PIECE:
                    digest = np.concatenate([d for *_, d in long_chunks(texts[a])] or [np.zeros(0, np.uint64)])
                    doc = firsts = np.zeros(len(digest), int)
                else:
                    words = Words(texts[a:b])
                    starts, _, digest = chunks(words)
                    doc = words.doc[starts]
                    firsts = np.searchsorted(doc, doc)
                e = np.empty(len(digest), _ENTRY)
                e["digest"], e["id"], e["tag"] = digest, ids[a:b][doc], tags[a:b].astype(np.uint32)[doc]
                e["place"] = np.arange(len(doc)) - firsts
                entries.append(e)
                held += len(e)
                if held >= BLOCK_CHUNKS:
                    yield flush(entries, number)
                    entries, held, number = [], 0, number + 1
        if entries and held:
            yield flush(entries, number)
        entries = []
        let_go()

    return docs.mapInArrow(run, "frag int, kind int, data binary")


def _repeats(rows: DataFrame) -> DataFrame:
    """(id, tag, places) of the repeated chunks that a fragment knows of, by document."""

    def run(table: pa.Table) -> pa.Table:
        kind, data = table.column(1).to_numpy(), table.column(2).to_pylist()
        found = [np.frombuffer(d, _PLACE) for d, k in zip(data, kind, strict=True) if k == 1]
        parts = [np.frombuffer(d, _ENTRY) for d, k in zip(data, kind, strict=True) if k == 0]
        if parts:
            every = np.concatenate(parts)
            order = np.argsort(every["digest"], kind="stable")
            digest = every["digest"][order]
            new = np.concatenate([[True], digest[1:] != digest[:-1]])
            many = ~new | np.concatenate([~new[1:], [False]])
            every = every[order[many]]
            every = every[np.lexsort((every["tag"], every["place"], every["id"], every["digest"]))]
            if len(every):
                new = np.concatenate([[True], every["digest"][1:] != every["digest"][:-1]])
                head = np.maximum.accumulate(np.where(new, np.arange(len(every)), 0))
                again = (every["id"] != every["id"][head]) | (every["place"] != every["place"][head]) | (every["tag"] != every["tag"][head])
                later = np.empty(int(again.sum()), _PLACE)
                for c in _PLACE.names:
                    later[c] = every[c][again]
                found.append(later)
        places = np.concatenate(found) if found else np.empty(0, _PLACE)
        places = places[np.lexsort((places["place"], places["tag"], places["id"]))]
        new = np.ones(len(places), bool)
        new[1:] = (places["id"][1:] != places["id"][:-1]) | (places["tag"][1:] != places["tag"][:-1])
        at = np.flatnonzero(new)
        blobs = [places["place"][a:b].tobytes() for a, b in zip(at, [*at[1:], len(places)][: len(at)], strict=True)]
        return pa.table({"id": pa.array(places["id"][at], pa.int64()), "tag": pa.array(places["tag"][at].astype(np.int64), pa.int64()), "places": pa.array(blobs, pa.binary())})

    return rows.groupBy("frag").applyInArrow(run, "id long, tag long, places binary")


def spans(text: bytes, repeated: np.ndarray, min_run: int = MIN_RUN) -> tuple[list[tuple[int, int]], int]:
    """Byte ranges of one text's runs of repeated chunks with min_run words or more, and their words."""
    begin, stop, count, _ = text_chunks(text)
    flag = np.zeros(len(begin) + 2, np.int8)
    flag[repeated[repeated < len(begin)] + 1] = 1
    step = np.diff(flag)
    out, gone = [], 0
    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        n = int(count[a:b].sum())
        if n >= min_run:
            out.append((int(begin[a]), int(stop[b - 1])))
            gone += n
    return out, gone


def without_repeats(docs: DataFrame, min_run: int = MIN_RUN, fragments: int | None = None) -> DataFrame:
    """docs with repeated passages taken out of text, and removed: their byte ranges in the UTF-8 of the old text, and
    removed_words. n_chars, if docs has it, is that of the new text wherever something was removed.

    A passage's first place, by document id and then by place in the text, keeps it; null ids come last. White space and
    the case of A-Z don't count. Rows that repeat id and text are one document and fare alike. Null, empty and wordless
    texts stay as they are, and an empty table stays empty. Every text is read whole, long ones in pieces. Other columns
    pass through, whatever their names; removed and removed_words are replaced.

    There is a power of two of fragments, by default as many as keep one at the chunks of FRAGMENT_BYTES.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("removed", "removed_words")
    if not fragments:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        fragments = max(partitions(spark), size / FRAGMENT_BYTES)
    fragments = power_of_two(fragments)
    tag = F.coalesce(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_ID)))
    keyed = docs.select(row_of(docs), F.col("text").alias("old"), key.alias("id"), tag.alias("tag"))
    sent = deal(_send(keyed.where("old is not null").select("id", "tag", "old"), even_keys(spark, fragments)), fragments)
    marks = _repeats(sent).groupBy("id", "tag").agg(F.collect_list("places").alias("places"))

    kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("removed_words", pa.int64())])

    @F.arrow_udf("text string, removed array<struct<start: int, end: int>>, removed_words long")
    def clean(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(text.cast(pa.binary()), places, strict=True):
            if not (t.is_valid and p.is_valid):
                out.append(None)
                continue
            raw = t.as_py()
            cuts, n = spans(raw, np.concatenate([np.frombuffer(x, "<u4") for x in p.as_py()]).astype(np.int64), min_run)
            kept, at = [], 0
            for a, b in cuts:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append({"text": b"".join(kept).decode(), "removed": [{"start": a, "end": b} for a, b in cuts], "removed_words": n})
        let_go()
        return pa.array(out, kind)

    joined = keyed.join(marks, ["id", "tag"], "left")
    marked = F.col("places").isNotNull()
    done = joined.withColumn("clean", clean(F.when(marked, F.col("old")), "places"))
    changed = marked & (F.col("clean.removed_words") > 0)
    new = {"text": F.when(changed, F.col("clean.text")).otherwise(F.col("old"))}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(changed, F.char_length("clean.text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    none = F.array().cast("array<struct<start: int, end: int>>")
    return done.select(
        *fields(docs, **new),
        F.when(changed, F.col("clean.removed")).otherwise(none).alias("removed"),
        F.when(changed, F.col("clean.removed_words")).otherwise(F.lit(0)).cast("long").alias("removed_words"),
    )
