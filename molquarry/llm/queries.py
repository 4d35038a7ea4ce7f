"""The registered queries of this subpackage: one for each operator, over the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, language_id, licenses, ngram_join, packing, quality_classifier, quality_rules, secrets, shards, substring_dedup, toxicity, whitening
from .common import own_dir
from .oracles import ORACLE_SQL as ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_read(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 3).cast("string"))), ",")
    return found.select("doc_id", "held_out", "lang_pred", "score", shown.alias("languages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base_spans"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.named(F.col("base_spans")), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, reads them again and returns what each record holds."""
    path = f"{own_dir(spark)}/shards-{uuid.uuid4().hex}"
    shards.write_shards(_read(spark, sf_dir, "documents"), path, tokenizer_path())
    return shards.digests(shards.read_from(spark, path))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)
    return whitening.long_form(rows, model).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    joined = {f"{c}": F.array_join(c, ",") for c in ("base_labels", "labels")}
    places = {"n_base": F.size("places").cast("long"), "first_word": F.try_element_at("places", F.lit(1)), "last_word": F.try_element_at("places", F.lit(-1))}
    return found.withColumns(joined | places).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scans": op8_secret_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op9_training_order": op9_training_order,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scans": op13_license_scans,
}
