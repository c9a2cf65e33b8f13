"""Approximate nearest neighbours by a forest of random-projection trees, a shared priority queue and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, prepare
from tidemark.llm.vectors import Tree, grow, leaves, matrix, sample, usable

#: Trees, levels of each, directions tried at each split, and the part of all rows that a query's leaves should hold.
TREES, DEPTH, TRIES, PROBED = 4, 6, 24, 1.2
#: Rows that a leaf should have at most: larger tables get deeper trees, as far as the sample can fit them.
LEAF = 8192
#: Rows of a leaf that one task holds; larger leaves are dealt over several.
BLOCK = 4096
#: Float noise of a matrix product that may not decide who is reranked.
SLACK = 1e-9


def probes(forest: list[Tree], q: np.ndarray, sizes: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) that one queue over all trees gives out, nearest first, until the leaves hold wanted rows.

    A node's key is the least distance by which the query lies on the wrong side of a plane on the way to it; the
    child on the query's side keeps its parent's key.
    """
    queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(len(forest))]
    out, held = [], 0.0
    while queue and held < wanted:
        key, t, node = heapq.heappop(queue)
        tree = forest[t]
        first = (1 << tree.depth) - 1
        while node < first:
            gap = float(tree.planes[node] @ q) - tree.offsets[node]
            near, far = (2 * node + 2, 2 * node + 1) if gap > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(key, abs(gap)), t, far))
            node = near
        if sizes[t][node - first]:
            out.append((t, node - first))
            held += sizes[t][node - first]
    return out


def _cut_at(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the top rows by score, ties to the smaller id."""
    return np.lexsort((ids, -score))[:top]


def nearest(rows: DataFrame, is_query, top: int = 20, trees: int = TREES, depth: int = DEPTH, probed: float = PROBED, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the top candidates found for each query by inner product, in double precision.

    is_query: a condition on vec_id. The trees split a bounded sample at medians; every row stands in one leaf of each
    tree. So that the largest inner product is the nearest point, rows get one more coordinate that brings them to the
    largest length. A query opens leaves of all trees by one priority queue until they hold probed * rows rows (rows of
    several trees count several times); candidates are scored exactly on the original vectors, a row never against
    itself (the same id), and ties go to the smaller id. Queries and rows meet by leaf in an equi-join; leaves of over
    BLOCK rows are dealt over several tasks, so none is capped, and a task returns at most top rows for each query.

    The data decide what probed has to be: vectors that are all about equally far apart, as random ones are, need most
    of the leaves for a recall of 0.9. Vectors that are null, zero or hold null or non-finite components, or of a
    length unlike most, and null ids take no part. Rows that repeat an id and vector count once.
    """
    spark = prepare(rows.sparkSession)
    good = usable(rows)
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size["d"] if size else 1
    points = cut(good.where(F.size("v") == dim).distinct())
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = points.agg(F.max(length)).first()[0] or 1.0

    def lifted(v: np.ndarray) -> np.ndarray:
        x = v / longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    x, n = sample(points, seed=seed)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = max(min(depth, int(np.log2(max(n, 8) / 8))), int(np.ceil(np.log2(n / LEAF))))
    forest = [grow(lifted(x), min(wanted, max(0, int(np.log2(max(len(x), 8) / 8)))), seed * 1000 + t, TRIES) for t in range(trees)]
    deep = forest[0].depth

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            if not len(v):
                continue
            at = lifted(v)
            codes = []
            for k, t in enumerate(forest):
                row, leaf = leaves(t, at)
                codes.append(leaf[np.argsort(row)] + (k << deep))
            codes = np.concatenate(codes)
            pick = pa.array(np.tile(np.arange(len(v)), len(forest)))
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column(0).take(pick), pa.array([v[i].tobytes() for i in range(len(v))] * len(forest), pa.binary())], names=["code", "id", "v"])

    index = points.select("id", "v").mapInArrow(place, "code long, id long, v binary")
    # at most trees * 2 ** depth rows, whatever the input
    counted = {r["code"]: r["count"] for r in index.groupBy("code").count().collect()}
    sizes = [np.array([counted.get((k << deep) + leaf, 0) for leaf in range(1 << deep)]) for k in range(trees)]
    blocks = {c: -(-m // BLOCK) for c, m in counted.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            code, block, who = [], [], []
            for i, q in enumerate(v):
                unit = np.append(q / max(np.linalg.norm(q), 1e-300), 0.0)
                for t, leaf in probes(forest, unit, sizes, probed * n):
                    c = (t << deep) + leaf
                    for b in range(blocks[c]):
                        code.append(c)
                        block.append(b)
                        who.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(block, pa.int32()), batch.column(0).take(pa.array(who, pa.int64())), pa.array([v[i].tobytes() for i in who], pa.binary())], names=["code", "block", "query_id", "q"])

    count = F.element_at(F.create_map(*[F.lit(x) for c, b in sorted(blocks.items()) if b > 1 for x in (c, b)]), F.col("code")) if any(b > 1 for b in blocks.values()) else F.lit(None).cast("int")
    dealt = index.withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce(count, F.lit(1)).cast("long")).cast("int"))
    asked = points.where(is_query(F.col("id"))).select("id", "v").mapInArrow(ask, "code long, block int, query_id long, q binary")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, who = left.column("id").to_numpy(), right.column("query_id").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(who):
            v = np.stack([np.frombuffer(b, np.float64) for b in left.column("v").to_pylist()])
            q = np.stack([np.frombuffer(b, np.float64) for b in right.column("q").to_pylist()])
            for s in range(0, len(who), 256):
                rough = q[s : s + 256] @ v.T
                for i, line in enumerate(rough):
                    me = who[s + i]
                    line[ids == me] = -np.inf
                    k = min(top, len(line))
                    least = np.partition(line, len(line) - k)[len(line) - k]
                    near = np.flatnonzero(line >= least - SLACK * max(1.0, abs(least) if np.isfinite(least) else 1.0))
                    near = near[ids[near] != me]
                    exact = (v[near] * q[s + i]).sum(1)
                    best = near[o := _cut_at(exact, ids[near], top)]
                    out.append((np.full(len(best), me), ids[best], exact[o]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    key = ("code", "block")
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # a candidate of several trees has the same exact score in each
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
