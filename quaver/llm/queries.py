"""One query per corpus operator, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, decontaminate, katz, merkle, mixing, near_dedup, pii, preference, quality, set_join, sql, toxicity, url_filter, warc
from .workspace import materialize

#: Folder of the public tokenizers' files, the same on every executor.
TOKENIZERS = "/opt/tokenizers"
#: Key of the surrogates in the registered query; production runs bring their own.
PII_KEY = "quaver-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return report.select("doc_id", *quality.METRICS, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    weights = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, weights).select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _spans(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another's last reply, so that every pair has a prompt."""
    turns = table(spark, sf_dir, "conversations")
    rejected = materialize(preference.other_replies(turns), "rejected")
    pairs = rejected.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id")).distinct()
    found = preference.format_pairs(turns, pairs, rejected_turns=rejected)
    return found.select("chosen_id", "rejected_id", "n_common", "prompt", "chosen", _spans("chosen_spans"), "rejected", _spans("rejected_spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), share=80, k=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(table(spark, sf_dir, "pages"))
    return made.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_headers", "payload_digest", "block_digest", "content_length")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count="n_entities")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens.alignment(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = F.when(F.col("groups_text") == "", "").otherwise(F.sha2("groups_text", 256)).alias("groups_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proofs, checked against rows of which some claim another length."""
    told = merkle.leaf_hash(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, told)
    made = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), claim=claim))
    return made.select(F.col("order_value").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("lefts"), F.col("rights")).alias("proof_sha256"), "folded_root", "verified")


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.joined(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_quality_rules, op3_decontamination, op4_katz_backoff, op5_toxicity, op6_preference_pairs, op7_mixing, op8_minhash_near_dedup, op9_warc_derivatives, op10_pii_surrogates, op11_tokenizer_alignment, op12_merkle_manifest, op13_set_join)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": sql.OP1, "op2_quality_rules": sql.OP2, "op3_decontamination": sql.OP3, "op6_preference_pairs": sql.OP6, "op9_warc_derivatives": sql.OP9, "op12_merkle_manifest": sql.OP12}
