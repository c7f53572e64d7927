"""One query per operator, over the whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (bpe_codec, conversation_repair, decontaminate, html_text, language_id, license_scan, near_dup,
                       nn_descent, packing, periodic_runs, substring_dedup, toxicity, warc)
from quire.llm.common import held_out, table


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (5 words, 0.75)."""
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learns from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier 100-byte string repeats."""
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds: at least 0.6 of the item's
    words in tiles of five words or more."""
    found = decontaminate.tiled(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back in byte ranges."""
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text decoded from them."""
    ids = bpe_codec.encode(table(spark, sf_dir, "documents"))
    return bpe_codec.decode(ids).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, after the planted ones."""
    docs = periodic_runs.planted(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.runs_and_collapsed(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost repair of every conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(turns), turns.select("conv_id"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_toxicity, op3_nn_descent, op4_decontaminate, op5_suffix_dedup, op6_packing, op7_minhash,
    op8_language_id, op9_warc, op10_html_text, op11_bpe_codec, op12_periodic_runs, op13_conversation_repair)}
