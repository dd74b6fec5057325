"""Exact per-row attributions of tree models against a background sample.

For a row x and a background row b a leaf is reached by the mixed rows that take certain
features from x (those whose path conditions only x meets, u of them) and certain others
from b (v of them), if x or b meets every condition.  The Shapley value of that indicator
is (u-1)! v! / (u+v)! for each feature of the first kind and -u! (v-1)! / (u+v)! for each
of the second, so a row's contributions are a sum over leaves and background rows: every
background row counts, and the contributions add up to the model's value at x minus its
mean over the background.

Boosted trees have too many leaves for a product with a background.  For them a feature that
isn't known is averaged over the training rows of the tree's nodes: a leaf on a path with
features k counts ``prod o_k`` where x meets the condition of k (0 or 1) or, for an unknown
feature, ``z_k``, the share of the rows that go that way.  Its Shapley value is

    value * (o_j - z_j) * integral over t in [0, 1] of prod over k != j of (z_k (1 - t) + o_k t)

and the integrand is a polynomial of degree below the depth, so Gauss-Legendre quadrature
with half as many nodes is exact: the cost is leaves x depth, on the scale of the log-odds.

The work is split by rows: a task holds one Arrow batch, the leaves and, for single trees
and forests, the background (at most ``max_background`` rows, refused beyond), all of a size
known beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Leaf = tuple[float, list[int], list[float], list[float]]   # value, features, lower bounds, upper bounds


def tree_leaves(spark: SparkSession, model_path: str) -> list[Leaf]:
    """Leaves of a saved decision tree or random forest classifier, with the share of
    class 1 (over the number of trees) as value; x meets a bound when lower < x <= upper."""
    nodes = spark.read.parquet(model_path.rstrip("/") + "/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID"), "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = {(r["treeID"], r["id"]): r for r in nodes.collect()}     # as large as the model
    trees = sorted({t for t, _ in rows})
    leaves: list[Leaf] = []
    for t in trees:
        open_nodes = [(0, {})]
        while open_nodes:
            i, bounds = open_nodes.pop()
            node = rows[(t, i)]
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                features = sorted(bounds)
                leaves.append((stats[1] / sum(stats) / len(trees), features, [bounds[f][0] for f in features],
                               [bounds[f][1] for f in features]))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("only splits on continuous features are supported")
            f, at = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            lo, hi = bounds.get(f, (-math.inf, math.inf))
            open_nodes.append((node["leftChild"], {**bounds, f: (lo, min(hi, at))}))
            open_nodes.append((node["rightChild"], {**bounds, f: (max(lo, at), hi)}))
    return leaves


def _meets(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """1.0 where a value meets its bounds; NaN goes right at every split, as in Spark."""
    return (~(x <= lo) & ((x <= hi) | np.isinf(hi))).astype(float)


def _patterns(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a 0/1 matrix and the place of each row among them: all that a leaf
    sees of a row is which of its conditions are met."""
    codes = met.astype(np.int64) @ (1 << np.arange(met.shape[1], dtype=np.int64))
    if 1 << met.shape[1] <= len(met):       # few conditions: no sort
        seen = np.flatnonzero(np.bincount(codes, minlength=1))
        place = np.zeros(1 << met.shape[1], dtype=np.int64)
        place[seen] = np.arange(len(seen))
        of_row = place[codes]
    else:
        seen, of_row = np.unique(codes, return_inverse=True)
    return (seen[:, None] >> np.arange(met.shape[1]) & 1).astype(float), of_row


def contributions(x: np.ndarray, background: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Rows x features; averaged over the background rows."""
    out = np.zeros(x.shape)
    deepest = max((len(f) for _, f, _, _ in leaves), default=0)
    plus, minus = np.zeros((deepest + 1, deepest + 1)), np.zeros((deepest + 1, deepest + 1))
    for u in range(deepest + 1):
        for v in range(deepest + 1 - u):
            if u:
                plus[u, v] = math.factorial(u - 1) * math.factorial(v) / math.factorial(u + v)
            if v:
                minus[u, v] = math.factorial(u) * math.factorial(v - 1) / math.factorial(u + v)
    for value, features, lo, hi in leaves:
        if not features:
            continue
        bs = _meets(background[:, features], np.array(lo), np.array(hi))
        xs, of_row = _patterns(_meets(x[:, features], np.array(lo), np.array(hi)))
        only_b, only_x = 1 - xs, 1 - bs
        reached = only_b @ only_x.T == 0
        u, v = (xs @ only_x.T).astype(int), (only_b @ bs.T).astype(int)
        u, v = np.where(reached, u, 0), np.where(reached, v, 0)
        share = value / len(background)
        out[:, features] += (share * (xs * (plus[u, v] @ only_x) - only_b * (minus[u, v] @ bs)))[of_row]
    return out


def tree_values(df: DataFrame, background: DataFrame, cols: list[str], leaves: list[Leaf],
                key: str = "plate_no", max_background: int = 100) -> DataFrame:
    """(key, x, phi): per row of ``df`` the values of ``cols`` and their contributions to the
    probability of class 1, as two arrays.  A NULL feature goes right at every split, as NaN
    does in Spark, and its value stays NULL."""
    bg_rows = background.select(*[F.col(c).cast("double") for c in cols]).limit(max_background + 1).collect()
    if not bg_rows:
        raise ValueError("empty background sample")
    if len(bg_rows) > max_background:
        raise ValueError(f"the background sample has more than {max_background} rows")
    nan = float("nan")
    bg = np.array([[nan if v is None else v for v in r] for r in bg_rows])
    return _values(df, cols, lambda x: contributions(x, bg, leaves), key)


def tree_attribution(df: DataFrame, background: DataFrame, cols: list[str], leaves: list[Leaf],
                     key: str = "plate_no", max_background: int = 100) -> DataFrame:
    """:func:`tree_values` as long rows (key, feature_index, feature, value, contribution, scale)."""
    return long_rows(tree_values(df, background, cols, leaves, key, max_background), cols, key, "probability")


def _values(df: DataFrame, cols: list[str], explain, key: str) -> DataFrame:
    nan, d = float("nan"), len(cols)
    x = df.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(nan)) for c in cols]).alias("x"))

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            ends = np.arange(n + 1, dtype=np.int32) * d
            yield pa.RecordBatch.from_arrays([batch.column(key), *(
                pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel(), from_pandas=True))
                for v in (rows, explain(rows)))], names=[key, "x", "phi"])

    doubles = ArrayType(DoubleType())
    return x.mapInArrow(attribute, StructType([x.schema[key], StructField("x", doubles), StructField("phi", doubles)]))


def long_rows(values: DataFrame, cols: list[str], key: str, scale: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    out = values.select(key, F.posexplode(F.arrays_zip("x", "phi")).alias("i", "a"))
    return out.select(key, F.col("i").alias("feature_index"), names[F.col("i")].alias("feature"),
                      F.col("a.x").alias("value"), F.col("a.phi").alias("contribution"),
                      F.lit(scale).alias("scale"))


# ---- boosted trees: path weights instead of a background

PathLeaf = tuple[float, list[int], list[float], list[float], list[float]]   # a Leaf and the shares z


def boosted_leaves(spark: SparkSession, model_path: str, weights: list[float]) -> list[PathLeaf]:
    """Leaves of a saved gradient-boosted classifier on the log-odds scale (twice the margin),
    with the shares of each path feature's conditions by the training rows of the nodes."""
    nodes = spark.read.parquet(model_path.rstrip("/") + "/data").select("treeID", "nodeData.*")
    rows = {(r["treeID"], r["id"]): r for r in nodes.collect()}     # as large as the model
    leaves: list[PathLeaf] = []
    for t, weight in enumerate(weights):
        todo = [(0, {})]
        while todo:
            i, bounds = todo.pop()
            node = rows[(t, i)]
            if node["leftChild"] < 0:
                features = sorted(bounds)
                leaves.append((2.0 * weight * node["prediction"], features, *([bounds[f][k] for f in features] for k in range(3))))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("only splits on continuous features are supported")
            f, at = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            lo, hi, z = bounds.get(f, (-math.inf, math.inf, 1.0))
            total = rows[(t, node["leftChild"])]["rawCount"] + rows[(t, node["rightChild"])]["rawCount"]
            left = rows[(t, node["leftChild"])]["rawCount"] / total
            todo.append((node["leftChild"], {**bounds, f: (lo, min(hi, at), z * left)}))
            todo.append((node["rightChild"], {**bounds, f: (max(lo, at), hi, z * (1 - left))}))
    return leaves


def expected(leaves: list[PathLeaf]) -> float:
    """Value of the model when no feature is known."""
    return float(sum(v * math.prod(z) for v, _, _, _, z in leaves))


def path_contributions(x: np.ndarray, leaves: list[PathLeaf]) -> np.ndarray:
    """Rows x features; they add up to the model's log-odds minus :func:`expected`."""
    out = np.zeros(x.shape)
    for value, features, lo, hi, share in leaves:
        d = len(features)
        if not d:
            continue
        o, of_row = _patterns(_meets(x[:, features], np.array(lo), np.array(hi)))
        z = np.array(share)
        nodes, w = np.polynomial.legendre.leggauss((d + 1) // 2)
        phi = np.zeros((len(o), d))
        for t, wt in zip((nodes + 1) / 2, w / 2, strict=True):
            factor = z * (1 - t) + o * t                    # patterns x d, never 0 since 0 < t < 1 and z > 0
            phi += wt * factor.prod(axis=1, keepdims=True) / factor
        out[:, features] += (value * (o - z) * phi)[of_row]
    return out


def path_values(df: DataFrame, cols: list[str], leaves: list[PathLeaf], key: str = "plate_no") -> DataFrame:
    """(key, x, phi) as :func:`tree_values` has them, on the scale of the log-odds."""
    return _values(df, cols, lambda x: path_contributions(x, leaves), key)


def path_attribution(df: DataFrame, cols: list[str], leaves: list[PathLeaf], key: str = "plate_no") -> DataFrame:
    """Long rows (key, feature_index, feature, value, contribution, scale) of the log-odds."""
    return long_rows(path_values(df, cols, leaves, key), cols, key, "log_odds")
