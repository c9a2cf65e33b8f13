"""Vectors as numpy blocks, and forests of random-projection trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import draw, share

#: Bound of the vectors that trees are fitted on.
SAMPLE = 20_000


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector is neither null nor zero, without null or non-finite components, and whose id isn't null."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sample(vectors: DataFrame, bound: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, int]:
    """About bound vectors, drawn by id, in order of id; and how many there are."""
    n = vectors.count()
    rows = vectors.where(draw("id", seed) < share(bound, n)).orderBy("id", "v").limit(2 * bound).toArrow()
    return matrix(rows.column("v")), n


@dataclass
class Tree:
    """A full binary tree of depth levels: node k has the children 2k + 1 and 2k + 2; leaf i is node 2 ** depth - 1 + i."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int


def grow(x: np.ndarray, depth: int, seed: int, tries: int = 1) -> Tree:
    """Splits each node at the median of its sample along a random direction: of tries, the one along which it spreads most."""
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    dim = x.shape[1] if x.ndim == 2 and x.shape[1] else 1
    planes, offsets = np.zeros((nodes, dim)), np.zeros(nodes)
    members = {0: np.arange(len(x))}
    for k in range(nodes):
        own = members.pop(k, np.zeros(0, int))
        directions = rng.standard_normal((tries, dim))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        best = directions[0]
        if len(own) and x.shape[1]:
            along = x[own] @ directions.T
            j = int(np.argmax(along.std(0)))
            best, offsets[k] = directions[j], float(np.median(along[:, j]))
            right = along[:, j] > offsets[k]
            members[2 * k + 1], members[2 * k + 2] = own[~right], own[right]
        planes[k] = best
    return Tree(planes, offsets, depth)


def leaves(tree: Tree, x: np.ndarray, spill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): every leaf a row falls into; within spill of a plane it goes to both sides."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        gap = np.einsum("ij,ij->i", x[row], tree.planes[node]) - tree.offsets[node]
        left, right = gap <= spill, gap > -spill
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - ((1 << tree.depth) - 1)


@dataclass
class SpillTree:
    """A tree with one random direction a level and a cut for each node of the first levels.

    cuts[l] has 2 ** l numbers while the sample had rows enough to cut each node at its own median; deeper levels cut
    at the sample's median along their direction, so a tree may be deeper than any sample could fit. reach[l] is how
    near to a cut of level l a row has to be to count as near.
    """

    directions: np.ndarray
    cuts: list[np.ndarray]
    reach: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        """For each row its leaf, and the leaf on the other side of the cut to which it is nearest, for its level, or -1.

        So a row is in two leaves at most, whatever the dimension and depth.
        """
        depth = len(self.directions)
        along = x @ self.directions.T if depth else np.zeros((len(x), 0))
        ratio = np.ones((len(x), depth))
        own = self._descend(along, np.full(len(x), -1), ratio)
        if not depth:
            return np.column_stack([own, np.full(len(x), -1)]).astype(np.int32)
        turn = ratio.argmin(1)
        near = ratio[np.arange(len(x)), turn] <= 1
        other = np.full(len(x), -1)
        other[near] = self._descend(along[near], turn[near], None)
        return np.column_stack([own, other]).astype(np.int32)

    def _descend(self, along: np.ndarray, turn: np.ndarray, ratio: np.ndarray | None) -> np.ndarray:
        node = np.zeros(len(along), np.int64)
        for level, cut in enumerate(self.cuts):
            gap = along[:, level] - cut[node if len(cut) > 1 else 0]
            if ratio is not None:
                ratio[:, level] = np.abs(gap) / max(self.reach[level], 1e-300)
            node = 2 * node + ((gap > 0) ^ (turn == level))
        return node


def grow_spill(x: np.ndarray, depth: int, share: float, seed: int, least: int = 64) -> SpillTree:
    """A SpillTree of that depth fitted on the rows of x; at each level a share of them is near to its cut."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((depth, x.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
    along = x @ directions.T
    node = np.zeros(len(x), np.int64)
    cuts, reach = [], []
    for level in range(depth):
        v = along[:, level]
        middle = float(np.median(v)) if len(v) else 0.0
        if level == 0 or len(x) >> level < least:
            cut = np.array([middle])
        else:
            cut = np.full(1 << level, middle)
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                cut[k] = np.median(v[order[edges[k] : edges[k + 1]]])
        gap = v - cut[node if len(cut) > 1 else 0]
        cuts.append(cut)
        reach.append(float(np.quantile(np.abs(gap), share)) if len(gap) else 0.0)
        node = 2 * node + (gap > 0)
    return SpillTree(directions, cuts, np.array(reach))
