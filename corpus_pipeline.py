"""Corpus pipeline: five stages over the documents, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, mixing, quality, simhash
from tillroll.llm.common import drop_folder, read_table
from tillroll.llm.queries import token_report
from tillroll.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled ones of these documents and keeps those likely good."""
    model = quality.fit(docs, quality.grades(read_table(spark, sf_dir, "labels")))
    return quality.select_good(docs, model).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, one row a group."""
    return simhash.keep_one_a_group(docs, shingle=3, bits=3).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaked_rows(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Token files, read back: a row a document of the mix. The files and
    ``manifest.parquet`` stay in ``folder`` (default: a new ``tillroll-corpus-*``
    in spark.checkpoint.dir)."""
    return token_report(docs, folder or scratch_path(spark, "corpus"))


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination),
          ("mixing sources to target weights", mix_sources), ("token-ID / binary output", token_output)]

#: Not SQL: the classifier's fit and the tokenizer. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages; the token files go to ``folder`` (see ``token_output``). A
    stage's documents go once the next stage's are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = scratch_path(spark, f"stage{i}")
        more = {"folder": folder} if stage is token_output else {}
        stage(spark, docs, sf_dir, **more).write.parquet(out)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
