"""Keyed state of the rolling-record stream (S13): which record of a plate was accepted.

The state is one key table in a RocksDB store: a key per distinct record, and one per plate
that has had a sound record.  A micro-batch gets each new key once, so a record is
judged by the rows of its own micro-batch, without reading anything that was stored before
and without a call per plate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.lookup import settled

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCEPTED, SECOND, NO_PLATE, NO_FURNACE = "accepted", "second_rolling_record", "plate_missing", "furnace_record_missing"


def key_table(plates: DataFrame, furnace: DataFrame) -> DataFrame:
    """(plate_no, has_plate, has_furnace), one row per known plate: the one side that every
    micro-batch is joined with."""
    known = furnace.select("plate_no", F.lit(True).alias("f")).distinct()
    return plates.select("plate_no").distinct().join(known, "plate_no", "left").select(
        "plate_no", F.lit(True).alias("has_plate"), F.coalesce("f", F.lit(False)).alias("has_furnace"))


def arrivals(stream: DataFrame, keys: DataFrame, columns: list[str], history: DataFrame | None = None) -> DataFrame:
    """The stream's new keys: each distinct record once, and a row with ``first_sound`` when a
    plate has its first sound record (plate and furnace record known).  A record sent again is
    dropped, however late it comes, unless its plate or furnace record has turned up since:
    then it is judged anew.  ``history``: rolling records accepted before the stream began;
    their plates get no such row."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if history is not None:
        keys = keys.join(history.select("plate_no", F.lit(True).alias("taken")).distinct(), "plate_no", "left")
    else:
        keys = keys.withColumn("taken", F.lit(False))
    flags = ["has_plate", "has_furnace", "taken"]
    flagged = stream.join(settled(keys), "plate_no", "left").select(
        *columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    opens = F.col("has_plate") & F.col("has_furnace") & ~F.col("taken")
    rows = flagged.withColumn("first_sound", F.explode(
        F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).drop("taken")
    at = F.when(~F.col("first_sound"), F.col("rolling_date"))
    return rows.withColumn("__at", at).dropDuplicates(["plate_no", "__at", "has_plate", "has_furnace", "first_sound"]).drop("__at")


def judged(batch: DataFrame, columns: list[str]) -> DataFrame:
    """UNIQUE(plate_no) over the whole stream: the records of a micro-batch of
    :func:`arrivals` with their ``outcome``, 'accepted' or the reason why not.  Of a plate's
    sound records the first to arrive is accepted, in one micro-batch the one with the
    earliest instant (NULL first); the others are second records.  Records without a plate or
    a furnace record don't count for that."""
    mine = Window.partitionBy("plate_no")
    instant = F.struct(F.col("rolling_date").isNotNull(), F.col("rolling_date"))
    sound = F.col("has_plate") & F.col("has_furnace") & ~F.col("first_sound")
    ranked = batch.withColumns({"__opens": F.max("first_sound").over(mine),
                                "__earliest": F.min(F.when(sound, instant)).over(mine)})
    outcome = (F.when(~F.col("has_plate"), NO_PLATE).when(~F.col("has_furnace"), NO_FURNACE)
               .when(F.col("__opens") & F.col("__earliest").eqNullSafe(instant), ACCEPTED).otherwise(SECOND))
    return ranked.filter(~F.col("first_sound")).select(*columns, outcome.alias("outcome"))
