"""Registered queries of the numbered operators: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe as BP
from platewise.llm import conversation as CO
from platewise.llm import langid as LI
from platewise.llm import mtree as MT
from platewise.llm import packing as PA
from platewise.llm import periodic as PE
from platewise.llm import quality as QR
from platewise.llm import sharding as SH
from platewise.llm import simhash as SI
from platewise.llm import substrings as SU
from platewise.llm import suffixes as SX
from platewise.llm import tokencount as TC
from platewise.llm import warc as WA
from platewise.llm.common import persisted, scratch, table, words


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    path = scratch(spark, "warc")
    WA.write_warc(table(spark, sf_dir, "pages"), path)
    r = WA.read_warc(spark, path)
    response = F.col("record_type") == "response"
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return r.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = BP.decode(BP.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    out = TC.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document after cutting what repeats 13 words of an earlier one."""
    out = SU.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
                      F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near-equal bytes."""
    out = SH.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = QR.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 512 to 4096 words."""
    return PA.pack(table(spark, sf_dir, "documents"), capacities=(512, 1024, 2048, 4096))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every vector whose id is divisible by 100."""
    vectors = MT.integer_vectors(table(spark, sf_dir, "embeddings"), scale=1024)
    return MT.search(MT.index(vectors), vectors.filter(F.col("id") % 100 == 0), k=10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, 2 bits."""
    out = SI.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", SI.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    labelled = LI.training_texts(docs, ~LI.held_out())
    return LI.predict(docs, labelled, carry=["doc_id"]).select(
        "doc_id", F.coalesce(LI.held_out(), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"))


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that a hash of (conv_id, turn)
    deals out."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
        (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("damage"))
    kept = rows.filter("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, audited and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged_conversations(conversations)
    found = persisted(CO.audits(rows), "audits")
    hashes = CO.digests(rows, found).select(F.col("conv").alias("hc"), "sha256")
    zero = F.lit(0).cast("long")
    out = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("hc")), "left")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of the id, become periodic from
    one of their words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w, n = F.col("w"), F.size("w")
    first = g % n
    period = F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < first, i).otherwise(first + (i - first) % period))
    made = F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them made periodic."""
    out = PE.periodic_runs(with_periods(table(spark, sf_dir, "documents")), carry=["doc_id"])
    line = F.transform("__runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    # length / period as exact fractions: the greater one first, ties by start, then period
    best = F.reduce("__runs", F.get("__runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return out.withColumn("best", best).select(
        "doc_id", F.size("__runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("__runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias(
            "runs_sha256"),
        F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document after cutting what repeats 100 bytes that start earlier."""
    out = SX.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
                      F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_bpe, op3_token_counts, op4_substrings, op5_sharding, op6_quality_rules, op7_packing, op8_top_k, op9_simhash,
    op10_language_id, op11_conversation_repair, op12_periodic_runs, op13_suffix_dedup)}
