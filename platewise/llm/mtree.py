"""Exact top-k by inner product: M-trees searched best first.

**Index.**  Vectors (components ``floor(scale * x)``, integers) are dealt by the hash of
their ids into trees of about ``tree`` vectors.  Each is bulk-loaded into an M-tree whose
nodes are rows of a written table of pages: a routing vector, a covering radius, the
distance to the parent's routing vector and, for a leaf, its vectors with their distances to
the routing vector.  Distances are Euclidean.

**Search.**  For a query q and a node with routing vector c and radius r every vector x
inside has ``q.x <= q.c + |q| * r``.  The search takes the node with the highest bound
first and stops when no bound reaches the k-th score.  Before a child's ``q.c`` is
computed, the stored distance d to its parent bounds it by ``q.parent + |q| * (d + r)``
(triangle inequality); the same holds for the vectors of a leaf.  What cannot reach the
k-th score by these stored bounds is never computed.  Bounds are widened by more than the
rounding error, and scores are exact integers.

A task searches one tree for one block of queries, so its memory holds a tree and a block;
each tree gives at most k rows a query, which a ranking over all trees merges.

Vectors that are null or hold a null or non-finite component take no part.  Vectors of
different lengths have no inner product: trees hold vectors of one length and answer
queries of that length.  A query isn't its own candidate: rows with its id are left out.
Repeated rows are candidates each; a repeated query row is asked once.  Ties go to the
smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import persisted

TREE = 8192
LEAF = 128
FANOUT = 16
BLOCK = 512


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v array<long>, dim) of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.size(vector_col).alias("dim"))


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> list[dict]:
    """Pages of a tree, the root first; ``parent`` is a page's parent (-1: root)."""
    x = vectors.astype(np.float64)
    pages: list[dict] = []
    todo = [(np.arange(len(ids)), -1, None)]
    while todo:
        rows, parent, above = todo.pop()
        mean = x[rows].mean(axis=0)
        centre = rows[np.linalg.norm(x[rows] - mean, axis=1).argmin()]
        far = np.linalg.norm(x[rows] - x[centre], axis=1)
        page = {"page": len(pages), "parent": parent, "centre": vectors[centre].tolist(), "radius": float(far.max()),
                "to_parent": float(np.linalg.norm(x[centre] - above)) if above is not None else 0.0,
                "ids": None, "vectors": None, "distances": None}
        pages.append(page)
        if len(rows) > leaf and page["radius"] > 0:
            # routing vectors: far from each other, from a bounded stride of the rows
            some = rows[::max(1, len(rows) // (32 * fanout))]
            chosen, near = [some[0]], np.linalg.norm(x[some] - x[some[0]], axis=1)
            while len(chosen) < fanout and near.max() > 0:
                chosen.append(some[near.argmax()])
                near = np.minimum(near, np.linalg.norm(x[some] - x[chosen[-1]], axis=1))
            owner = np.stack([np.linalg.norm(x[rows] - x[c], axis=1) for c in chosen]).argmin(axis=0)
            parts = [rows[owner == k] for k in range(len(chosen))]
            if max(map(len, parts)) < len(rows):
                todo.extend((p, page["page"], x[centre]) for p in parts if len(p))
                continue
        order = np.argsort(far, kind="stable")
        page |= {"ids": ids[rows][order].tolist(), "vectors": vectors[rows][order].ravel().tolist(),
                 "distances": far[order].tolist()}
    return pages


class Tree:
    """A tree put together from its pages."""

    def __init__(self, pages: list[dict]):
        dim = len(pages[0]["centre"])
        self.centres = np.array([p["centre"] for p in pages], np.int64).reshape(len(pages), dim)
        self.radius = np.array([p["radius"] for p in pages])
        self.to_parent = np.array([p["to_parent"] for p in pages])
        self.root = next(i for i, p in enumerate(pages) if p["parent"] < 0)
        place = {p["page"]: i for i, p in enumerate(pages)}
        self.children: list[list[int]] = [[] for _ in pages]
        for i, p in enumerate(pages):
            if p["parent"] >= 0:
                self.children[place[p["parent"]]].append(i)
        self.children = [np.array(c, np.int64) for c in self.children]
        self.leaves = [(np.asarray(p["ids"], np.int64), np.asarray(p["vectors"], np.int64).reshape(len(p["ids"]), dim),
                        np.asarray(p["distances"])) if p["ids"] is not None else None for p in pages]
        self.largest = max([1.0, *(float(np.abs(v[1].astype(np.float64)).max(initial=0)) for v in self.leaves if v)])
        self.floats: list = [None if v is None else v[1].astype(np.float64) for v in self.leaves]
        self.float_centres = self.centres.astype(np.float64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k highest (score, id), ties to smaller ids, best first."""
        q = query.astype(np.float64)
        norm = float(np.linalg.norm(q))
        # sums below 2**53 are exact in doubles
        exact = float(np.abs(q).max(initial=0)) * self.largest * max(len(q), 1) < 2.0**52
        slack = 1e-9 * norm * self.largest * max(len(q), 1) + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        floor = -np.inf
        at = float(q @ self.float_centres[self.root])
        queue = [(-(at + norm * self.radius[self.root]), self.root, at)]
        while queue:
            bound, node, at = heapq.heappop(queue)
            if -bound + slack < floor:
                break
            if self.leaves[node] is not None:
                ids, vectors, distances = self.leaves[node]
                # by the stored distances alone
                rows = np.flatnonzero((at + norm * distances + slack >= floor) & (ids != query_id))
                scores = (self.floats[node][rows] @ q).astype(np.int64) if exact else vectors[rows] @ query
                for s, i in zip(scores.tolist(), ids[rows].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    floor = best[0][0]
                continue
            kids = self.children[node]
            if floor > -np.inf:  # by the stored distances alone
                kids = kids[at + norm * (self.to_parent[kids] + self.radius[kids]) + slack >= floor]
            for kid, c in zip(kids.tolist(), (self.float_centres[kids] @ q).tolist(), strict=True):
                high = c + norm * self.radius[kid]
                if high + slack >= floor:
                    heapq.heappush(queue, (-high, kid, c))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


_PAGES = ("dim int, tree int, page int, parent int, centre array<long>, radius double, to_parent double, "
          "ids array<long>, vectors array<long>, distances array<double>")


def index(vectors: DataFrame, tree: int = TREE, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """The written pages of the trees over ``vectors`` (id, v, dim)."""
    trees = max(1, -(-vectors.count() // tree))

    def load(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        pages = build(part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.int64).reshape(len(part), key[0]),
                      leaf, fanout)
        out = pd.DataFrame(pages)
        out.insert(0, "tree", key[1])
        out.insert(0, "dim", key[0])
        return out

    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("id", "v"), F.lit(trees)).cast("int"))
    return persisted(dealt.groupBy("dim", "tree").applyInPandas(load, _PAGES), "mtree-pages")


def search(pages: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (id, v, dim) over the trees."""
    asked = persisted(queries.distinct(), "mtree-queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # every block meets every tree of its length: the stated query set against all rows
    trees = pages.select("dim", "tree").distinct()
    sides = asked.select("dim", "block").distinct()
    to_trees = asked.join(trees, "dim").select(
        "id", "v", *[F.col(c).alias(f"for_{c}") for c in ("dim", "tree", "block")])
    to_blocks = pages.join(sides, "dim")

    def run(key: tuple, tree: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(tree) and len(ask):
            held = Tree(tree.to_dict("records"))
            for i, v in zip(ask["id"], ask["v"], strict=True):
                rows += [(i, x, s) for s, x in held.top(int(i), np.asarray(v, np.int64), k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = to_blocks.groupBy("dim", "tree", "block").cogroup(
        to_trees.groupBy("for_dim", "for_tree", "for_block")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
