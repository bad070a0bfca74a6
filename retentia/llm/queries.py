"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontam, langid, lbl_lm, line_dedup, line_rules, merkle, ngram_join, packing, quality_cotrain, stream_dedup, token_counts, toxicity
from .common import bucket, crc_mod, scratch, table

COUNT_TOKENIZER = "byte_bpe_50k.json"
PACK_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file lies (the same on every node)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer, _ = toxicity.fit(docs, labels, crc_mod("doc_id", 5) != 0)
    out = toxicity.score(docs, scorer)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(COUNT_TOKENIZER))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cotrain.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    out = langid.identify(docs, langid.fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "exact-dedup")
    stream_dedup.absorb(stream_dedup.document_stream(spark, f"{sf_dir}/documents.parquet"), folder)
    return stream_dedup.decisions(table(spark, sf_dir, "documents"), stream_dedup.groups(spark, folder))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.coalesce(bucket("doc_id", 7) == 0, F.lit(False)))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_line_dedup, op4_quality, op5_ngram_join,
    op6_decontamination, op7_packing, op8_language, op9_line_rules, op10_lm_score,
    op11_exact_dedup, op12_conversations, op13_merkle,
)}
