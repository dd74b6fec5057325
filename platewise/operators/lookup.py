"""Small-side helpers: sides whose bytes the planner can see, and scalar subqueries.

The planner can't estimate an aggregate or a rank, so a join with one is planned as if
the side were as large as its source.  ``settled`` writes such a side once to the
shared checkpoint folder and reads it back: its true bytes are then known, and Spark
broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges it
above.  Nothing passes through the driver, and a lost executor doesn't compute the
side again.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.session import ensure_checkpoint_dir


def settled(side: DataFrame) -> DataFrame:
    """``side`` written to the shared checkpoint folder and read back."""
    spark = side.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"side-{uuid.uuid4().hex}")
    side.write.parquet(path)
    return spark.read.schema(side.schema).parquet(path)


def with_scalars(df: DataFrame, agg_df: DataFrame, name: str = "__scalars") -> tuple[DataFrame, Column]:
    """Attach a one-row aggregate as a struct column computed by one scalar subquery.

    Returns the frame and a column handle; read fields with ``handle[field]`` and drop
    ``name`` afterwards.  No join is planned: Spark runs the subquery once and inlines it.
    """
    packed = agg_df.select(F.struct(*agg_df.columns).alias(name))
    return df.withColumn(name, packed.scalar()), F.col(name)
