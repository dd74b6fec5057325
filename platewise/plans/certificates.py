"""Certificates of fitted models (M3, M4, M9): statements that hold exactly if a fit is what it
claims to be, each computed from the rows by aggregates and none by the learner itself.

* Logistic regression: at the optimum of the weighted, regularised loss every partial
  derivative vanishes; features are measured in standard deviations, so that a tolerance
  means the same for all of them.
* Decision tree: the share of a leaf is the weighted share of the rows that reach it, and no
  split of an inner node on a feature with few values gains more than the one chosen.
* Fold layout: every training row has one fold, folds differ by at most one row per class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS_PER_CORE = 2


def logistic_gradient(train: DataFrame, model, cols: list[str]) -> DataFrame:
    """(feature, slope): derivative of mean weighted log-loss plus penalty with respect to the
    coefficient of each feature in units of its standard deviation, while the intercept
    keeps the mean; and with respect to the intercept.  One aggregate."""
    reg = model.getOrDefault("regParam")
    error = vector_to_array("probability")[1] - F.col("label")
    rows = model.transform(train).select(*[F.col(f"`{c}`") for c in cols], "weight", error.alias("__e"))
    w = F.sum("weight")
    sums = rows.agg(*[F.struct((F.sum(F.col("weight") * F.col("__e") * F.col(f"`{c}`")) / w
                                - F.avg(F.col(f"`{c}`")) * F.sum(F.col("weight") * F.col("__e")) / w + F.lit(reg * float(b))).alias("g"),
                               F.stddev_pop(F.col(f"`{c}`")).alias("s")).alias(f"c{i}")
                      for i, (c, b) in enumerate(zip(cols, model.coefficients, strict=True))],
                    F.struct((F.sum(F.col("weight") * F.col("__e")) / w).alias("g"), F.lit(1.0).alias("s")).alias("intercept"))
    names = [*cols, "(intercept)"]
    items = [F.struct(F.lit(n).alias("feature"), (F.col(f"{c}.g") / F.when(F.col(f"{c}.s") > 0, F.col(f"{c}.s")).otherwise(1.0)).alias("slope"))
             for n, c in zip(names, [*(f"c{i}" for i in range(len(cols))), "intercept"], strict=True)]
    return sums.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def tree_nodes(spark: SparkSession, path: str) -> list[dict]:
    """Nodes of a saved decision tree with the bounds of the rows that reach them; as many as
    the model has."""
    nodes = {r["id"]: r for r in spark.read.parquet(path.rstrip("/") + "/data").collect()}
    out, todo = [], [(0, [])]
    while todo:
        i, path_to = todo.pop()
        n = nodes[i]
        out.append({"id": i, "path": path_to, "leaf": n["leftChild"] < 0, "stats": list(n["impurityStats"]), "gain": n["gain"],
                    "feature": n["split"]["featureIndex"], "count": n["rawCount"]})
        if n["leftChild"] >= 0:
            f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            todo += [(n["leftChild"], [*path_to, (f, at, True)]), (n["rightChild"], [*path_to, (f, at, False)])]
    return out


def _reaches(path: list[tuple], cols: list[str]) -> Column:
    ok = F.lit(True)
    for f, at, left in path:
        c = F.col(f"`{cols[f]}`") <= F.lit(at)
        ok = ok & (c if left else ~c)
    return ok


def leaf_shares(train: DataFrame, nodes: list[dict], cols: list[str]) -> DataFrame:
    """(node, holds): the stored weights of both classes of each leaf are those of its rows."""
    leaves = [n for n in nodes if n["leaf"]]
    sums = train.agg(*[F.struct(F.sum(F.when(_reaches(n["path"], cols) & (F.col("label") == 0), F.col("weight")).otherwise(0.0)).alias("neg"),
                                F.sum(F.when(_reaches(n["path"], cols) & (F.col("label") == 1), F.col("weight")).otherwise(0.0)).alias("pos")
                                ).alias(f"n{n['id']}") for n in leaves])
    items = [F.struct(F.lit(n["id"]).alias("node"), (
        (F.abs(F.col(f"n{n['id']}.neg") - n["stats"][0]) < 1e-6 * (1 + n["stats"][0]))
        & (F.abs(F.col(f"n{n['id']}.pos") - n["stats"][1]) < 1e-6 * (1 + n["stats"][1]))).alias("holds")) for n in leaves]
    return sums.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def few_values(train: DataFrame, cols: list[str], few: int) -> dict[str, np.ndarray]:
    """The values, in order, of each column with at most ``few`` of them.  A task gives up a column
    with more, so what it sends is bounded."""
    d = len(cols)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.empty(0)] * d
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            for j in range(d):
                if seen[j] is not None:
                    v = np.union1d(seen[j], x[:, j])
                    seen[j] = v if len(v) <= few else None
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "v": pa.array(
            [None if v is None else v.tolist() for v in seen], pa.list_(pa.float64()))})

    values: list[set | None] = [set() for _ in cols]
    for r in _spread(train.select(_vector(cols))).mapInArrow(task, "i int, v array<double>").collect():
        i = r["i"]
        values[i] = None if values[i] is None or r["v"] is None else values[i] | set(r["v"])
    return {c: np.array(sorted(v)) for c, v in zip(cols, values, strict=True) if v is not None and len(v) <= few}


def _vector(cols: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x")


def _spread(rows: DataFrame) -> DataFrame:
    """No more tasks than keep the cores busy: each of them sends its sums to the driver."""
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def best_splits(train: DataFrame, nodes: list[dict], cols: list[str], few: int = 32) -> DataFrame:
    """(node, holds): no threshold on a feature with at most ``few`` values, both sides not
    empty, gains more than the split of the inner node.  A task adds up the weights of the rows
    by leaf, feature and value; the sums of an inner node are those of the leaves below it."""
    inner, leaves = [n for n in nodes if not n["leaf"]], [n for n in nodes if n["leaf"]]
    values = few_values(train, cols, few)
    small = [(cols.index(c), v) for c, v in values.items()]
    first = np.concatenate([[0], np.cumsum([len(v) for _, v in small])]).astype(np.int64)
    paths, d, shape = [n["path"] for n in leaves], len(cols), (2, len(leaves), int(first[-1]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            leaf = np.zeros(len(x), dtype=np.int64)
            for i, path in enumerate(paths):
                here = np.ones(len(x), dtype=bool)
                for f, at, left in path:
                    here &= (x[:, f] <= at) == left
                leaf[here] = i
            row = ((y != 1) * shape[1] + leaf) * shape[2]
            for (f, v), start in zip(small, first, strict=False):
                total += np.bincount(row + start + np.searchsorted(v, x[:, f]), weights=w, minlength=total.size).reshape(shape)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    rows = _spread(train.select(_vector(cols), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")))
    sums = sum((np.frombuffer(r["sums"]).reshape(shape) for r in rows.mapInArrow(task, "sums binary").collect()), np.zeros(shape))

    def gini(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        n = np.where(pos + neg > 0, pos + neg, 1.0)
        return np.where(pos + neg > 0, 1.0 - (pos / n) ** 2 - (neg / n) ** 2, 0.0)

    out = []
    for n in inner:
        below = [i for i, p in enumerate(paths) if p[:len(n["path"])] == n["path"]]
        here, best = sums[:, below].sum(axis=1), 0.0
        for start, end in zip(first[:-1], first[1:], strict=True):
            (lp, ln), (tp, tn) = np.cumsum(here[:, start:end - 1], axis=1), here[:, start:end].sum(axis=1)
            rp, rn, size = tp - lp, tn - ln, tp + tn
            # the values of a node may be fewer than those of the feature: both sides have rows
            some = (lp + ln > 1e-9 * size) & (rp + rn > 1e-9 * size)
            gain = gini(tp, tn) - (lp + ln) / size * gini(lp, ln) - (rp + rn) / size * gini(rp, rn)
            best = max(best, float(gain[some].max(initial=0.0)))
        out.append((n["id"], bool(best <= n["gain"] + 1e-9)))
    return train.sparkSession.createDataFrame(out, "node int, holds boolean")


def fold_layout(folds: DataFrame, label: str) -> DataFrame:
    """(label, holds): the folds of a class differ by at most one row."""
    n = folds.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(label).agg((F.max("n") - F.min("n") <= 1).alias("holds"))
