"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, prepare
from tidemark.llm.graph import components, smallest_reached
from tidemark.llm.vectors import SpillTree, grow_spill, matrix, sample, usable

#: Rows that a leaf should have at most, the share of rows that each level counts as near its cut, and the least trees.
LEAF, SPILL, TREES = 8192, 0.1, 3
#: Part of the pairs just at the threshold that shall meet in some leaf: trees are added until made-up ones do.
RECALL = 0.98
#: Rows of a block; larger leaves are compared block by block, each pair of blocks in a task of its own.
BLOCK = 16384
#: Rows and bytes within which a task collapses equal vectors before they go down the trees.
TOGETHER, TOGETHER_BYTES = 65_536, 64 << 20


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; the largest component is made 1 first, so nothing overflows."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-320)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def forest(x: np.ndarray, depth: int, threshold: float, share: float = SPILL, recall: float = RECALL, least: int = TREES, most: int = 400, seed: int = 10) -> list[SpillTree]:
    """As many trees as it takes for pairs at the threshold to meet: partners of sampled rows are made up and sent down.

    A table that is one leaf needs one tree.
    """
    rng = np.random.default_rng(seed)
    a = x[:: max(1, len(x) // 2000)]
    b = rng.standard_normal(a.shape)
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    size = np.linalg.norm(b, axis=1, keepdims=True)
    b = np.where(size > 1e-9, threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(size, 1e-300), a)
    apart = np.ones(len(a), bool)
    trees: list[SpillTree] = []
    while len(trees) < most and (len(trees) < (least if depth else 1) or apart.mean() > 1 - recall):
        trees.append(grow_spill(x, depth, share, seed * 1000 + len(trees)))
        p, q = trees[-1].places(a), trees[-1].places(b)
        apart &= ~_met(p, q)
    return trees


def _met(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether rows with the leaves p and q of one tree share one."""
    return (p[:, 0] == q[:, 0]) | (p[:, 0] == q[:, 1]) | (p[:, 1] == q[:, 0]) | ((p[:, 1] == q[:, 1]) & (p[:, 1] >= 0))


def near_duplicates(
    rows: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, recall: float = RECALL, seed: int = 10
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of rows; only vec_id and embedding are read.

    Each tree cuts at medians of a bounded sample along random directions; every vector goes down every tree, and near a
    cut to both sides, at the one cut of the tree to which it is nearest, so to two leaves at most. The depth follows
    the number of rows, so that leaves keep their size; at least trees trees are grown, and more until recall of
    made-up pairs just at the threshold share a leaf. Vectors that share a leaf are compared by cosine in double
    precision. A pair that shares several leaves counts in the first only, so that n_links is the number of different
    vectors found at threshold or above. From a leaf come counts and one link per vector to the smallest it reaches
    there, never the pairs.

    Equal vectors of a task are collapsed before the trees and counted by weight, so that a vector that a third of all
    rows hold goes down once a task. Leaves of over BLOCK rows are compared block against block, so none is capped.
    Vectors that are null, zero or hold null or non-finite components, or of a length unlike most, and rows with null
    ids, link with nothing: n_links 0, component_id their id. Rows that repeat an id are one vector if their vectors are
    equal; otherwise they share links, and each row of the id gets the sum. An empty table gives an empty one.
    """
    spark = prepare(rows.sparkSession)
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    wire = np.dtype("<f4" if single else "<f8")
    good = usable(rows).withColumn("v", F.col("v").cast("array<float>")) if single else usable(rows)
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size["d"] if size else 1
    good = good.where(F.size("v") == dim)
    if not good.groupBy("id").count().where("count > 1").isEmpty():
        good = good.distinct()
    x, n = sample(good, seed=seed)
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    grown = forest(unit(x), depth, threshold, spill, recall, trees, seed=seed) if len(x) else []
    together = max(1, min(TOGETHER, TOGETHER_BYTES // (wire.itemsize * dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[np.ndarray], vectors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            every, v = np.concatenate(ids), np.concatenate(vectors)
            order = np.argsort(every, kind="stable")  # the smallest id of equal vectors comes first
            every, v = every[order], np.ascontiguousarray(v[order]) + 0.0
            _, first, inverse = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
            head = first[inverse.ravel()]
            weight = np.bincount(head, minlength=len(every))[head]
            leads = head == np.arange(len(every))
            for s in range(0, len(every), 4096):
                part = slice(s, s + 4096)
                u = unit(v[part])
                where = np.concatenate([t.places(u) for t in grown], axis=1)
                lead = leads[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every[part]), pa.array(every[head[part]]), pa.array(weight[part]),
                        pa.array([r.tobytes() if k else None for r, k in zip(v[part], lead, strict=True)], pa.binary()),
                        pa.array([r if k else None for r, k in zip(where, lead, strict=True)], pa.list_(pa.int32())),
                    ],
                    names=["id", "rep", "weight", "v", "codes"],
                )

        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy())
            vectors.append(matrix(batch.column(1)).astype(wire))
            held += batch.num_rows
            if held >= together:
                yield from flush(ids, vectors)
                ids, vectors, held = [], [], 0
        if held:
            yield from flush(ids, vectors)

    placed = cut(good.select("id", "v").mapInArrow(place, "id long, rep long, weight long, v binary, codes array<int>"))
    # (tree, leaf) of a row: the leaves stand in pairs, tree by tree
    codes = placed.where("v is not null").select("*", F.posexplode("codes").alias("slot", "leaf")).where("leaf >= 0").withColumn("tree", F.floor(F.col("slot") / 2).cast("int"))
    sizes = codes.groupBy("tree", "leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    large = sizes.select("tree", "leaf", F.ceil(F.col("rows") * 2 / BLOCK).cast("int").alias("blocks"))
    # a leaf of k blocks makes tasks (i, j), i <= j; a row of block b belongs to all that name b
    blocked = codes.join(large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = blocked.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    tasks = tasks.select("tree", "leaf", "low", "high", "block", "rep", "weight", "v", "codes")
    slack = 2.4e-7 * (dim + 16)  # what a product of unit rows in single precision can be off

    def compare(table: pa.Table) -> pa.Table:
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        block = table.column("block").to_numpy()
        low, high, here, leaf = (int(table.column(c)[0].as_py()) for c in ("low", "high", "tree", "leaf"))
        v = unit(np.frombuffer(b"".join(table.column("v").to_pylist()), wire).reshape(-1, dim))
        rough = v.astype(np.float32)
        where = matrix(table.column("codes")).reshape(len(rep), -1, 2)
        left, right = (np.flatnonzero(block == low), np.flatnonzero(block == high))
        across = np.ascontiguousarray(rough[right].T)
        label = np.arange(len(rep))
        found = np.zeros(len(rep), np.int64)
        for s in range(0, len(left), 512):
            part = left[s : s + 512]
            near = rough[part] @ across
            i, j = np.nonzero(near >= threshold - slack)
            sure = near[i, j] >= threshold + slack
            i, j = part[i], right[j]
            if low == high:
                sure, i, j = sure[i < j], i[i < j], j[i < j]
            open_ = np.flatnonzero(~sure)
            for t in range(0, len(open_), 50_000):
                k = open_[t : t + 50_000]
                sure[k] = np.einsum("ij,ij->i", v[i[k]], v[j[k]]) >= threshold
            i, j = i[sure], j[sure]
            a, b = label[i], label[j]
            if (a != b).any():
                label = smallest_reached(a, b, len(rep))[label]
            for t in range(here):  # pairs that met in an earlier tree were counted there
                apart = ~_met(where[i, t], where[j, t])
                i, j = i[apart], j[apart]
            # a pair with two leaves of this tree in common counts where the row of the smaller place has its own leaf
            twice = (where[i, here] >= 0).all(1) & (np.sort(where[i, here], 1) == np.sort(where[j, here], 1)).all(1)
            fresh = ~twice | (where[i, here].min(1) == leaf)
            i, j = i[fresh], j[fresh]
            found += np.bincount(i, weight[j], len(rep)).astype(np.int64) + np.bincount(j, weight[i], len(rep)).astype(np.int64)
        lowest = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, rep)
        hub = lowest[label]
        say = (found > 0) | (hub != rep)
        return pa.table({"rep": pa.array(rep[say]), "found": pa.array(found[say]), "hub": pa.array(hub[say])})

    out = cut(tasks.groupBy("tree", "leaf", "low", "high").applyInArrow(compare, "rep long, found long, hub long"))
    per = out.groupBy("rep").agg(F.sum("found").alias("found"))
    inside = placed.select("id", "rep", "weight")
    # an id with several vectors belongs to several classes, and joins them
    edges = out.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct().union(inside.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    member = components(edges)
    same = inside.groupBy("id", "rep").agg(F.sum(F.col("weight") - 1).alias("same"))
    links = same.join(per, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("found", F.lit(0)) + F.col("same")).alias("links"))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    full = named.join(links, named["vec_id"] == links["id"], "left").join(member, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return full.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
