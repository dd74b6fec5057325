"""Distributed ordering primitives: exact global rank, global prefix sums, latest row
per key.

An un-partitioned window (``row_number() OVER (ORDER BY ...)``) moves every row into one
task.  Instead:

* ``global_rank`` range-partitions on a *total* order (so one hot timestamp is still
  split by the tie-break key), sorts each partition, numbers rows locally with
  ``monotonically_increasing_id`` (partition id in the high bits, local index in the
  low 33 bits), and adds the exact offset of its partition.  The offset table has one
  row per partition - a proven bound - so its broadcast is safe.  No second shuffle of
  the data is needed.  Range bounds come from sampling, so two evaluations of the same
  plan may cut partitions differently; the numbered data is therefore materialised once
  with a reliable ``checkpoint()`` (shared checkpoint folder) and both the per-partition
  counts and the rows are read from that one copy.  This also cuts the lineage, so an
  executor loss later does not re-run the sort.
* ``prefix_sums`` does the same for running totals of an already-aggregated table.
* ``latest_by`` keeps one row per key with ``row_number() = 1``; Catalyst plans a
  partial ``WindowGroupLimit`` before the shuffle, so a key holding a third of the
  rows sends one row per input partition, not its whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _ranged(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    """Range-partitioned on ``order``: into ``partitions`` if given, else into the
    session's shuffle partitions, which AQE joins to its advisory size."""
    return df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)


def global_rank_with_total(df: DataFrame, order: list, rank_col: str = "pos",
                           partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add the exact 0-based position of each row under ``order``; also return the row
    count.

    ``order`` must be a total order (end with a unique key), which makes the result
    deterministic.  The numbered rows are checkpointed, so the counts and the rows come
    from one copy.  The per-partition counts (one number per partition - a proven bound)
    are turned into offsets on the driver and applied as a literal array indexed by the
    partition id: no join and no further job over the data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (_ranged(df, order, partitions).sortWithinPartitions(*order)
              .withColumn("__mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    pid = F.shiftright("__mid", 33).cast("int")
    counts = dict(ranged.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, acc = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.array(*[F.lit(o).cast("bigint") for o in offsets]) if offsets else F.array().cast("array<bigint>")
    out = (ranged.withColumn(rank_col, off[pid] + F.col("__mid").bitwiseAND(F.lit(_LOW33)))
                 .drop("__mid"))
    return out, acc


def global_rank(df: DataFrame, order: list, rank_col: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add the exact 0-based position of each row under ``order`` (see
    :func:`global_rank_with_total`)."""
    return global_rank_with_total(df, order, rank_col, partitions)[0]


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str], by: list[str] | None = None,
                partitions: int | None = None) -> DataFrame:
    """For each ``out -> col`` in ``sums`` add the exclusive running total of ``col``
    over the preceding rows in ``order`` (a total order), restarting per ``by`` group.
    Intended for aggregated tables (one row per distinct score, day, ...).

    Range partitioning on (by..., order) keeps each group contiguous; local running
    sums are windows per (partition, group); the carry-in of a group from earlier
    partitions comes from a per-(partition, group) totals table, whose size is at most
    #groups + #partitions.
    """
    by = by or []
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (_ranged(df, [*by, *order], partitions).withColumn("__pid", F.spark_partition_id())
              .checkpoint(eager=True))
    w_local = Window.partitionBy("__pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"__l_{o}": F.coalesce(F.sum(c).over(w_local), F.lit(0)) for o, c in sums.items()})
    totals = ranged.groupBy("__pid", *by).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("__pid", *by, *[F.coalesce(F.sum(f"__t_{o}").over(w), F.lit(0)).alias(f"__o_{o}") for o in sums])
    # ``local`` is already partitioned by the join keys; only the totals move
    out = local.join(offs, ["__pid", *by])
    out = out.withColumns({o: F.col(f"__o_{o}") + F.col(f"__l_{o}") for o in sums})
    return out.drop("__pid", *[f"__l_{o}" for o in sums], *[f"__o_{o}" for o in sums])


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys``: the first under ``order`` (e.g. newest first, then
    explicit tie-breaks so 'latest' is defined on equal instants)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
