"""Exact set-similarity join on word shingles by vertical partitioning.

1. One pass over the texts cuts the global shingle order into fragments (ranges of the shingle's hash). Every block of
   documents sends each fragment one packed row: which of its documents hold which shingles there.
2. Each fragment counts, on its own, how many different sets hold each of its shingles, and sends back those that more
   than one holds, for one document of each set. A set whose shared shingles are under the threshold can link with
   nothing and drops out; the others are classes.
3. In order of rising count, a class's first n - ceil(t * n) + 1 shingles are its prefix; two classes that link share
   one of them, and shingles of one class, which come first, need not be looked up. Frequent passages stand last in
   the order and so seldom meet here.
4. Candidate pairs are checked exactly: each fragment counts the pair's partial overlap, the counts are summed by pair.
   No overlap exceeds the lesser number of shared shingles, and no two sets differ in fewer shingles than in bits of
   a parity bitmap, so pairs that these bounds rule out aren't candidates.

Only components are wanted, so a bucket of classes that share a prefix shingle isn't expanded into all pairs: first each
class is compared with one hub, the most central class that it meets; then, in buckets that still span several
components, with more and more hubs, most central first, until all are through or one component is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, deal, drop_cut, even_keys, fields, join_dealt, partitions, power_of_two, prepare, row_of
from tidemark.llm.graph import components
from tidemark.llm.text import let_go, set_digest, shingle_sets

#: Shingles that one block of documents holds before it is sent out, and documents in it at most.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 60_000
#: Shingles that a fragment should count at most: it is one group in one worker. There are as many fragments as that takes.
FRAGMENT_SHINGLES = 4_000_000
#: Fragments in which the overlaps of candidate pairs are counted.
CHECK_FRAGMENTS = 4
#: Hubs of a bucket that the second round compares with the rest of it; each later round takes GROWTH times as many.
HUBS, GROWTH = 256, 16
#: Rows of a bucket that one task compares with its hubs; larger buckets are dealt over several.
DEALT = 200

_ENTRY = np.dtype([("key", "<u4"), ("high", "<u2"), ("doc", "<u2")])
_SHARED = np.dtype([("token", "<u8"), ("count", "<u4"), ("doc", "<u2")])
_META = np.dtype([("n", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("bits", "<i8", 16)])


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the number of hashes that fall on it. Sets differ in at least as many hashes as bits."""
    odd = np.bincount((hashes >> np.uint64(5)).astype(np.int64) & 1023, minlength=1024) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def digests(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n, d1, d2): the number of distinct shingles of each row's text and 128 bits of their set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch, 1), size)
            d = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["doc_id", "n", "d1", "d2"])
        let_go()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def _bits(fragments: int) -> tuple[int, int, int]:
    """Bits of a shingle's hash that name its fragment, that an entry drops, and that it keeps: 48 or the rest of 64."""
    k = fragments.bit_length() - 1
    return k, max(0, 16 - k), min(48, 64 - k)


def _send(docs: DataFrame, size: int, keys: list[int] | range) -> DataFrame:
    """(frag, block, kind, data): kind 0 are a block's entries in a fragment, kind 1 is what the block's documents are.

    The data of kind 0 begin with the block's documents that have entries there, their number first, and the 128 bits
    of the set of each. frag is the fragment's key.
    """
    fragments = len(keys)
    k, drop, keep = _bits(fragments)

    def flush(block: int, sets: list[np.ndarray], meta: list[tuple]) -> pa.RecordBatch:
        every = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(every >> np.uint64(64 - k), kind="stable") if k else np.arange(len(every))
        every, doc = every[order], doc[order]
        entry = np.empty(len(every), _ENTRY)
        low = (every >> np.uint64(drop)) & np.uint64((1 << keep) - 1)
        entry["key"], entry["high"], entry["doc"] = low & np.uint64(0xFFFFFFFF), low >> np.uint64(32), doc
        frags, at = np.unique(every >> np.uint64(64 - k), return_index=True) if k else (np.zeros(1, int), np.zeros(1, int))
        known = np.array(meta, _META)
        digest = np.column_stack([known["d1"], known["d2"]])
        rows = []
        for f, a, b in zip(frags, at, [*at[1:], len(every)], strict=True):
            there = np.unique(doc[a:b])
            rows.append((keys[int(f)], block, 0, np.uint32(len(there)).tobytes() + there.tobytes() + digest[there].tobytes() + entry[a:b].tobytes()))
        rows.append((keys[((block >> 32) + block) % fragments], block, 1, known.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["frag", "block", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        sets: list[np.ndarray] = []
        meta: list[tuple] = []
        seen: set[tuple] = set()
        total = 0
        for batch in batches:
            for s in shingle_sets(_texts(batch, 0), size):
                if not len(s) or (m := (len(s), *set_digest(s))) in seen:
                    continue
                seen.add(m)
                meta.append((*m, parity_bits(s)))
                sets.append(s)
                total += len(s)
                if total >= BLOCK_SHINGLES or len(sets) >= BLOCK_DOCS:
                    yield flush(block, sets, meta)
                    block, sets, meta, seen, total = block + 1, [], [], set(), 0
        if sets:
            yield flush(block, sets, meta)
        sets, meta = [], []
        let_go()

    return docs.select("text").mapInArrow(run, "frag int, block long, kind int, data binary")


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, their digests, entries) of a row of kind 0."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    digest = np.frombuffer(data, "<i8", 2 * n, 4 + 2 * n).reshape(n, 2)
    return np.frombuffer(data, "<u2", n, 4), digest, np.frombuffer(data, _ENTRY, offset=4 + 18 * n)


def _count(rows: DataFrame, keys: list[int] | range) -> DataFrame:
    """Per fragment: entries whose shingle more than one set holds, back to the first block that has the set."""
    keep = _bits(len(keys))[2]
    place = {key: i for i, key in enumerate(keys)} if isinstance(keys, list) else keys

    def run(table: pa.Table) -> pa.Table:
        frag, block, kind = (table.column(i).to_numpy() for i in range(3))
        data = table.column(3).to_pylist()
        out = [(int(block[i]), 1, data[i]) for i in range(len(data)) if kind[i] == 1]
        parts = sorted((i for i in range(len(data)) if kind[i] == 0), key=lambda i: block[i])
        if parts:
            read = [_entries(data[i]) for i in parts]
            # sets by number: the copies of a set in several blocks have one number
            digest = np.concatenate([d for _, d, _ in read])
            order = np.lexsort((digest[:, 1], digest[:, 0]))
            digest = digest[order]
            number = np.zeros(len(digest), np.int32)
            number[order] = np.cumsum(np.concatenate([[False], (digest[1:] != digest[:-1]).any(1)]))
            base = np.cumsum([0, *(len(d) for d, _, _ in read)])
            every = np.concatenate([e for _, _, e in read])
            of = np.repeat(np.arange(len(read), dtype=np.int32), [len(e) for _, _, e in read])
            token = (every["high"].astype(np.uint64) << np.uint64(32)) | every["key"]
            order = np.argsort(token, kind="stable")
            token = token[order]
            again = token[1:] == token[:-1]
            many = np.concatenate([[False], again]) | np.concatenate([again, [False]])
            order, token = order[many], token[many]
            of, doc = of[order], every["doc"][order]
            del every
            set_ = np.empty(len(doc), np.int32)
            for i in np.unique(of):
                mine = of == i
                set_[mine] = number[base[i] + np.searchsorted(read[i][0], doc[mine])]
            # by shingle and set; of a set's documents that of the first block stands first
            order = np.lexsort((set_, token))
            token, of, doc, set_ = token[order], of[order], doc[order], set_[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (set_[1:] != set_[:-1])
            token, of, doc = token[new], of[new], doc[new]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
            count = np.diff(np.concatenate([first, [len(token)]]))
            count = np.repeat(count, count)
            many = count > 1
            shared = np.empty(int(many.sum()), _SHARED)
            shared["token"] = token[many] | (np.uint64(place[int(frag[0])]) << np.uint64(keep))
            shared["count"], shared["doc"], of = np.minimum(count[many], 0xFFFFFFFF), doc[many], of[many]
            order = np.argsort(of, kind="stable")
            shared, of = shared[order], of[order]
            which, at = np.unique(of, return_index=True)
            ends = np.append(at, len(of))[1:]  # none, where nothing is shared
            out += [(int(block[parts[w]]), 0, shared[a:b].tobytes()) for w, a, b in zip(which, at, ends, strict=True)]
        cols = zip(*out, strict=True) if out else ([], [], [])
        let_go()
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "kind", "data"])

    return rows.groupBy("frag").applyInArrow(run, "block long, kind int, data binary")


def _survivors(rows: DataFrame, fragments: int, percent: int) -> DataFrame:
    """(n, d1, d2, have, bits, central, prefix, segments) of the block's sets that have enough shared shingles to link."""
    keep = _bits(fragments)[2]

    def run(table: pa.Table) -> pa.Table:
        kind, data = table.column(1).to_numpy(), table.column(2).to_pylist()
        meta = np.frombuffer(next(d for d, k in zip(data, kind, strict=True) if k == 1), _META)
        shared = [np.frombuffer(d, _SHARED) for d, k in zip(data, kind, strict=True) if k == 0]
        out: list[tuple] = []
        if shared:
            every = np.concatenate(shared)
            have = np.bincount(every["doc"], minlength=len(meta))
            left = have * 100 >= percent * meta["n"]
            every = every[left[every["doc"]]]
            every = every[np.lexsort((every["token"], every["count"], every["doc"]))]
            edges = np.searchsorted(every["doc"], np.arange(len(meta) + 1))
            for i in np.flatnonzero(left):
                own = every[edges[i] : edges[i + 1]]
                n = int(meta["n"][i])
                take = n - -(-percent * n // 100) + 1 - (n - len(own))
                tokens = np.sort(own["token"])
                lane = ((tokens >> np.uint64(keep)) * np.uint64(CHECK_FRAGMENTS) // np.uint64(fragments)).astype(np.int64)
                cuts = np.searchsorted(lane, np.arange(1, CHECK_FRAGMENTS))
                common = float(np.log(own["count"]).mean())
                central = len(own) / n + 0.001 * common / (1 + common)
                out.append((n, int(meta["d1"][i]), int(meta["d2"][i]), len(own), meta["bits"][i], central, own["token"][:take].view(np.int64), np.split(tokens.view(np.int64), cuts)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["n", "d1", "d2", "have", "bits", "central", "prefix", "segments"])

    return rows.groupBy("block").applyInArrow(run, "n long, d1 long, d2 long, have long, bits array<long>, central double, prefix array<long>, segments array<array<long>>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: partial overlaps by fragment, summed by pair."""
    lanes = sets.select("rep", "n", F.posexplode("segments").alias("lane", "part"))
    left = lanes.select(F.col("rep").alias("a"), F.col("n").alias("na"), "lane", F.col("part").alias("pa"))
    right = lanes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "lane", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "lane"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("same"))
    total = partial.groupBy("a", "b").agg(F.sum("same").alias("same"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def _buckets(sets: DataFrame) -> DataFrame:
    """(token, rep, n, have, central, many): classes by prefix shingle where several share it."""
    entries = cut(sets.select(F.explode("prefix").alias("token"), "rep", "n", "have", "central"))
    many = cut(entries.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"))
    out = cut(join_dealt(entries, many, ["token"], entries.count()))
    drop_cut(entries, many)
    return out


def _may_link(percent: int):
    """Whether rep and hub may link by their sizes and shared shingles."""
    low = F.least("have", "hub_have")
    return (F.col("rep") != F.col("hub")) & (100 * low >= percent * (F.col("n") + F.col("hub_n") - low))


def _near_bits(percent: int):
    """Whether the parity bitmaps of rep and hub differ in no more bits than linked sets differ in shingles."""
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("hub_bits")[i])) for i in range(16)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("hub_n"))


def _parts():
    """Parts of a bucket: one of over DEALT classes is dealt over several tasks."""
    return F.ceil(F.col("many") / DEALT).cast("long")


def _central(still: DataFrame, upto: int, done: int) -> DataFrame:
    """Of each part of a bucket its share of the bucket's places done + 1 to upto, most central first.

    Each part ranks its own classes, so no task sees a whole bucket.
    """
    order = W.partitionBy("token", "salt").orderBy(F.desc("central"), F.desc("rep"))
    ranked = still.withColumn("place", F.row_number().over(order)).where(F.col("place") <= upto)
    return ranked.where((F.col("place") <= F.ceil(F.lit(upto) / _parts())) & (F.col("place") > F.ceil(F.lit(done) / _parts())))


def members(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) for all classes that links touch. classes: rep, n, have, bits, central, prefix, segments."""
    buckets = _buckets(classes)
    total = buckets.count()
    ordered = lambda df: df.select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    top = F.max_by(F.struct("rep", "n", "have", "central"), F.struct("central", "rep"))
    hubs = buckets.groupBy("token").agg(top.alias("hub"), F.max("many").alias("many"))
    hubs = cut(hubs.select("token", "many", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.have").alias("hub_have"), F.col("hub.central").alias("hub_central")))
    met = join_dealt(buckets.drop("many"), hubs, ["token"], total).where(_may_link(percent))
    best = met.groupBy("rep").agg(F.max_by("hub", F.struct("hub_central", "hub")).alias("hub"))
    tried = cut(ordered(best))
    found = cut(_linked(tried, classes, percent))
    member = components(found)
    drop_cut(hubs)
    done = 0
    while True:
        label = F.coalesce("component", "rep")
        # a part has all of a bucket's classes at most, so now every class of the other buckets has been a hub
        labelled = buckets.where(F.col("many") * _parts() > done).join(member, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "have", "central", "many", label.alias("component"))
        span = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("many").alias("many"))
        open_ = cut(span.where("low <> high").select("token", "many"))
        if open_.isEmpty():
            drop_cut(buckets, tried, found, open_)
            return member
        still = join_dealt(labelled.drop("many"), open_, ["token"], total)
        still = still.join(classes.select("rep", "bits"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), _parts()))
        still = cut(still)
        upto = HUBS if not done else done * GROWTH
        near = _central(still, upto, done)
        every = F.explode(F.sequence(F.lit(0).cast("long"), _parts() - 1))
        near = near.select("token", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("have").alias("hub_have"), F.col("bits").alias("hub_bits"), F.col("component").alias("hub_component"), every.alias("salt"))
        pairs = ordered(still.join(near, ["token", "salt"]).where(_may_link(percent) & _near_bits(percent) & (F.col("component") != F.col("hub_component"))))
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            new = cut(_linked(pairs, classes, percent))
            before, tried = tried, cut(tried.union(pairs))
            drop_cut(before)
            if not new.isEmpty():
                before, found, old = found, cut(found.union(new)), member
                member = components(found)
                drop_cut(before, old)
            drop_cut(new)
        drop_cut(open_, still, pairs)
        done = upto


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, fragments: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    docs: doc_id and text, other columns are ignored. Words are runs of anything but ASCII white space, A-Z in lower
    case; a document's set is its distinct size-word shingles, or its whole sequence of words where that is shorter.
    Two documents link when 100 * |intersection| >= percent * |union|; component_id is the smallest id that links
    reach. Null, empty and wordless texts have no shingles and link with nothing: they stand for themselves. A row
    with a null id counts its shingles, has a null component_id and links nothing. Rows that repeat an id get a row
    each; their links are joint. An empty table gives an empty one. Long texts are walked in pieces.

    Nothing is sampled or capped. Equal sets are told by their size and 128 bits. Two sets' shingles are compared by
    48 bits and those that number the fragments (a power of two; by default as many as keep one at FRAGMENT_SHINGLES),
    so 26 bits more than it takes to number all shingles.
    """
    spark = prepare(docs.sparkSession)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    meta = cut(digests(docs, size))
    rows, shingles = meta.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fragments = power_of_two(fragments or max(CHECK_FRAGMENTS, partitions(spark), shingles / FRAGMENT_SHINGLES))
    key = ["n", "d1", "d2"]
    real = meta.where("n > 0")
    classes = real.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("smallest"), F.count("*").alias("many"))
    keys = even_keys(spark, fragments)
    sent = deal(_send(known.where("text is not null"), size, keys), fragments)
    left = _survivors(_count(sent, keys), fragments, percent)
    # a number for each set, which stays since the table is written
    sets = cut(left.withColumn("rep", F.monotonically_increasing_id()))
    member = members(sets.select("rep", "n", "have", "bits", "central", "prefix", "segments"), percent)
    linked = sets.select(*key, "rep").join(member, F.col("rep") == F.col("node")).select(*key, "component")
    grouped = classes.join(linked, key, "left")
    smallest = grouped.where("component is not null").groupBy("component").agg(F.min("smallest").alias("least"))
    named = cut(grouped.join(smallest, "component", "left").select(*key, "many", F.coalesce("least", "smallest").alias("component_id")))
    # rows without an id have no part in the classes' counts, and need none
    out = join_dealt(real.where("doc_id is not null"), named, key, rows).select("doc_id", "n", "component_id")
    drop_cut(sets)
    alone = meta.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = _joint_ids(out).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _joint_ids(rows: DataFrame) -> DataFrame:
    """rows with one component for all rows of an id, and for all that they reach."""
    rows = cut(rows)
    low = rows.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    several = cut(low.where("low <> high").select("doc_id", F.col("low").alias("b")))
    if several.isEmpty():
        return rows
    same = components(rows.join(several, "doc_id").select(F.col("component_id").alias("a"), "b").where("a <> b"))
    return rows.join(same, F.col("component_id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies: of each group of similar_groups the document with the smallest id stays, once.

    Of rows that repeat that id the one whose text comes first stays. Rows with a null id stay, and so do empty and
    wordless texts. The columns are those of docs, whatever their names.
    """
    groups = similar_groups(docs, **options)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    # the window stands on the join's own partitioning: text is shuffled once
    stay = docs.where("doc_id is not null").select("doc_id", "text", row_of(docs)).join(keep, "doc_id", "left_semi")
    stay = stay.withColumn("turn", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("turn = 1")
    return stay.select(*fields(docs)).union(docs.where("doc_id is null"))
