"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from . import (
    decontaminate, importance, lines, mixing, pii, quality, sharding, simhash, spotsigs, substring, tokens, urls, variants)
from .common import drop_folder, read_table

#: Folder of the public tokenizer files; a local path on every executor.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def token_report(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Documents as read back from the token files. Files in a given ``folder``
    stay, with their manifest as ``manifest.parquet`` beside them; others go."""
    spark = docs.sparkSession
    place = (folder or scratch_path(spark, "tokens")).rstrip("/")
    manifest = tokens.write_tokens(docs, tokenizer_path(), place)
    if folder:
        manifest.write.parquet(f"{place}/manifest.parquet")
        return tokens.read_documents(manifest)
    found = cut_lineage(tokens.read_documents(manifest))
    tokens.drop_files(manifest)
    drop_folder(spark, place)  # what lost tasks left
    return found


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (lines.dedup_lines(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_removed",
                    F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read_table(spark, sf_dir, "documents"), window=13, digest_only=True)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"),
                               read_table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades(read_table(spark, sf_dir, "labels")))
    return quality.select_good(docs, model).select("doc_id", "expected_grade", "tail_probability")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), RULES)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_token_output, op3_line_dedup, op4_simhash, op5_shards, op6_substring_dedup,
    op7_spotsigs, op8_decontaminate, op9_quality, op10_url_filter,
    op11_spelling_variants, op12_pii, op13_importance, pipeline)}
