"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import ensure_checkpoint_dir

#: Java / RE2 / Python regex of the white space between words; a word is a maximal run
#: of anything else.  ``bytes.split()`` without arguments cuts at the same six bytes.
SPACE_CLASS = r"[ \x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, a
    lost executor loses nothing, and the planner knows the table's true size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files that ``persisted`` wrote for ``df``, once nothing reads them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def own_names(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ... so that nothing clashes with a working
    column, and the new names of ``cols``.  ``toDF(*docs.columns)`` undoes it."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), [new[docs.columns.index(c)] for c in cols]


_STATE: dict[tuple, Any] = {}


def worker_state(key: tuple, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker over its tasks (tables, caches).  A
    worker holds the state of one operator: the next one's replaces it."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def steps(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that results stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
