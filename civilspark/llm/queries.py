"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from civilspark.llm import (
    buckets,
    contamination,
    jaccard,
    language,
    licenses,
    lines,
    manifest,
    mixing,
    pq,
    scoring,
    secrets,
    shards,
    spelling,
)
from civilspark.llm.common import text_or_empty
from civilspark.llm.oracle import ORACLE
from civilspark.session import read_table, shared_folder

SHARDS = 8


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    ledger = shared_folder(spark, "ledger")
    secrets.scan_unseen(docs, None, "doc_id").write.parquet(ledger)
    found = secrets.findings(docs, spark.read.parquet(ledger), "doc_id")
    base = [r.kind for r in secrets.BASE_RULES]
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def n_of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [n_of(kind).alias(f"n_{kind}") for kind in base]
    return found.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(secrets.joined(own), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    models = scoring.fit(docs, read_table(spark, folder, "labels"))
    scored = scoring.score(docs, models)
    return scored.select(
        "doc_id",
        "n_tokens",
        *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")],
    )


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return jaccard.near_components(spark, docs, width=3, percent=90)


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = licenses.scan(spark, docs, licenses.train(spark, docs))
    return found.select(
        "doc_id",
        "paragraph",
        "family",
        F.round("probability", 4).alias("probability"),
        F.round("similarity", 4).alias("similarity"),
    )


def op5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.overlaps(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    )


def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return pq.near_vectors(spark, read_table(spark, folder, "embeddings"))


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.deduplicated(lines.build(spark, docs), docs)
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty("text"), 256).alias("kept_sha256")
    )


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    net = language.fit(docs.where(~language.held_out("doc_id")))
    labelled = language.identify(docs.select("doc_id", "text"), net)
    return labelled.select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.pack(spark, read_table(spark, folder, "documents"), bins=SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return buckets.pack(spark, read_table(spark, folder, "documents"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    # Rows whose id has a checksum that 7 divides are tampered with.
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    changed = F.when(chosen, more).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    rows = manifest.leaves(docs, altered={"n_chars": changed})
    proven = manifest.manifest(spark, rows)
    shown = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return proven.select(
        "doc_id",
        *[F.lower(F.hex(c)).alias(c) for c in shown],
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(spark, read_table(spark, folder, "documents"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.taken(spark, read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_secrets": op1_secrets,
    "op2_lm_score": op2_lm_score,
    "op3_jaccard": op3_jaccard,
    "op4_licenses": op4_licenses,
    "op5_contamination": op5_contamination,
    "op6_embeddings": op6_embeddings,
    "op7_lines": op7_lines,
    "op8_language": op8_language,
    "op9_shards": op9_shards,
    "op10_packing": op10_packing,
    "op11_manifest": op11_manifest,
    "op12_spelling": op12_spelling,
    "op13_mixing": op13_mixing,
}

__all__ = ["ORACLE", "QUERIES"]
