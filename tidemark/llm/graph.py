"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_cut

#: Edges up to which one task, which holds them in a few arrays, finds the components; beyond it stars do, over all tasks.
SMALL = 500_000


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n nodes that each reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.column_stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches]
    if parts:
        nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.reshape(-1, 2)
        label = smallest_reached(at[:, 0], at[:, 1], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _signature(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node that an edge touches; the component is its smallest node.

    edges: columns a, b of longs, in any direction, repeats allowed; nulls and loops are dropped. Up to small edges,
    which are counted first, one task does it all. Beyond, alternating
    large and small stars halve the diameter each round; a star of any size settles in one. Only per-node minima
    are grouped, which combine before the shuffle; the joins back are plain equi-joins that adaptive execution
    can split where a hub is hot. Raises if it hasn't settled after max_rounds.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    ).distinct()
    e, seen = cut(e), None
    if e.count() <= small:
        out = cut(e.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
        drop_cut(e)
        return out
    for _ in range(max_rounds):
        now = _signature(e)
        if now[0] == 0 or now == seen:
            break
        seen = now
        nxt = cut(_small_star(_large_star(e)))
        drop_cut(e)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select("b", F.col("b").alias("component")).distinct()
    )
