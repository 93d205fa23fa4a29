"""The registered queries of this subpackage: one per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.llm import alignment, audit, decontamination, languages, maxent, minhash, mixing, packing, spotsigs, sql, token_files, toxicity, warc, wrappers
from isobar.llm.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source; texts of 1,000 code points or more weigh twice as much as shorter ones."""
    weight = F.when(F.length("text") >= 1000, 2).otherwise(1)
    return mixing.mix(_table(spark, sf_dir, "documents"), weight=weight)


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to WARC files, read back and merged."""
    found = warc.archive(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards."""
    return packing.shard(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by b-bit MinHash."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return maxent.lm_scores(_table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return spotsigs.fingerprints(_table(spark, sf_dir, "documents"))


def tokenizer_spec(name: str = "word_bpe_49k.json") -> str:
    """The JSON of one of the installed public tokenizers."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to binary files and read back."""
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_spec())


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over all documents."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_spec("byte_bpe_50k.json"), model)


def op12_crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return languages.languages(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_toxicity": op1_compression_toxicity,
        "op2_pareto_mix": op2_pareto_mix,
        "op3_wrapper_induction": op3_wrapper_induction,
        "op4_latent_decontamination": op4_latent_decontamination,
        "op5_warc": op5_warc,
        "op6_vector_packing": op6_vector_packing,
        "op7_token_files": op7_token_files,
        "op8_minhash": op8_minhash,
        "op9_maxent": op9_maxent,
        "op10_spotsigs": op10_spotsigs,
        "op11_fragment_alignment": op11_fragment_alignment,
        "op12_crf_languages": op12_crf_languages,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_pareto_mix": sql.MIX, "op5_warc": sql.ARCHIVE, "op8_minhash": sql.NEAR_DUPLICATES, "op13_filter_audit": sql.AUDIT}
