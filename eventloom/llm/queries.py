"""The registered queries of this subpackage: thin digests over the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embeddings, mixing, quality, repair, resampling, simhash, sql, substring, suffix, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of near-duplicates by SimHash."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is held out (remainder 0 of 5), its toxicity score and label."""
    found = toxicity.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation digests of its turns and of its trainable text, read back from the formatted examples."""
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.examples(turns))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", sha("turns_text").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), "formatted_chars")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what the mix takes of it; sources weigh 1, 2, 3, repeating, by code point."""
    found = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"), lambda names: [i % 3 + 1 for i in range(len(names))])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its bytes and its tokens under word_bpe_49k.json."""
    import public_tokenizers

    return tokens.counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector its links, component, and whether it is kept."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is held out (remainder 1 of 3), its quality score and label."""
    found = quality.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words, the words inside benchmark phrases, whose they are, and whether it is contaminated."""
    found = decontam.contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words, the words removed as parts of 50-word windows of smaller documents, and what is kept."""
    found = substring.dedup(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the bytes, the bytes removed as parts of 50-byte strings of smaller documents, and what is kept."""
    found = suffix.dedup(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its features, weight and score towards the benchmark's words, and its rank among those drawn."""
    found = resampling.resampled(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, once damaged, its faults, the cheapest edits that repair it, and a digest of the repaired turns."""
    turns = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its payload's size and digest and its record, as read back from the archives."""
    pages = _table(spark, sf_dir, "pages")
    number = lambda c: F.col(c).cast(pages.schema["page_id"].dataType).alias(c)
    return warc.records(warc.archived(pages)).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_chat, op4_mixing, op5_tokens, op6_embeddings, op7_quality, op8_decontamination, op9_substring, op10_suffix, op11_resampling, op12_repair, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": sql.OP3, "op8_decontamination": sql.OP8, "op9_substring": sql.OP9, "op11_resampling": sql.OP11, "op12_repair": sql.OP12, "op13_warc": sql.OP13}
