"""The corpus pipeline: quality rules, language ID, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents``:

1. ``quality_rules``: documents that fail the base checks or the rule table go.
2. ``language_id``: documents in none of the languages learned from labelled rows go.
3. ``simhash_dedup``: of each near-duplicate group the document with the smallest id stays.
4. ``substring_dedup``: repeats of 13 words of earlier documents are cut from the texts;
   ``n_chars`` follows the text.  A document with no word left goes.
5. ``packing``: what is left, in sequences of 512 to 4096 words.

A stage over an empty input returns an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import langid, packing, quality, simhash, substrings
from platewise.llm.common import persisted, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=3, radius=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.keep_unrepeated(docs, length=13, size_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacities=(512, 1024, 2048, 4096))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_dedup", simhash_dedup),
          ("substring_dedup", substring_dedup), ("packing", best_fit_packing)]

#: SQL can't express the trained, hashed and packed stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
