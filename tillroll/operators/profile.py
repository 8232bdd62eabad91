"""Column profile from states by file, so that only new files are read.

A file's state of a column is its number of rows and nulls, its smallest and
largest value and a sketch of its distinct values. States add up: a profile is
made from the states of all files, without the data. The number of distinct
values is then an estimate, with a standard error of about 1.04 / sqrt(2^LOG_K);
``sales.column_profile`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.files import path_exists

#: 2^12 registers a sketch: a standard error of 1.6 %, 2 to 4 KB a file and column.
LOG_K = 12
STATE = ("source string, length long, modified timestamp, column_name string, rows long, nulls long, "
         "min_value string, max_value string, sketch binary")
#: Files that are read in one go; more go in several.
FILES_AT_ONCE = 10_000


def file_states(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """(source, column_name, rows, nulls, min_value, max_value, sketch): a row a
    source and column. Values are compared as text; columns that are absent are
    left out. One pass, one group a source and column."""
    cells = df.select(F.col(source).alias("source"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
        for c in columns if c in df.columns])).alias("_c")).select("source", "_c.*")
    return cells.groupBy("source", "column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"),
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.hll_sketch_agg("v", F.lit(LOG_K)).alias("sketch"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The stored states, of each file those of its last version."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STATE)
    last = Window.partitionBy("source", "column_name").orderBy(F.desc("modified"), F.desc("length"))
    return (spark.read.schema(STATE).parquet(path).withColumn("_k", F.row_number().over(last))
            .where("_k = 1").drop("_k"))


def refresh_states(spark: SparkSession, data_path: str, state_path: str, columns: list[str],
                   fmt: str = "parquet", schema: T.StructType | None = None) -> int:
    """Adds the states of the files under ``data_path`` that are new, or of
    another length or time than when they were read, and returns their number.
    Other files are listed but not opened. States are only added, so a run that
    fails is repeated; files that are gone keep theirs."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data_path)
              .select("path", F.col("_metadata.file_path").alias("source"), "length",
                      F.col("modificationTime").alias("modified")))
    known = read_states(spark, state_path).select("source", "length", "modified").distinct()
    new = [r for r in listed.join(known, ["source", "length", "modified"], "left_anti").orderBy("path").collect()]
    for at in range(0, len(new), FILES_AT_ONCE):
        some = new[at:at + FILES_AT_ONCE]
        reader = spark.read.format(fmt)
        data = (reader.schema(schema) if schema is not None else reader).load([r["path"] for r in some])
        facts = spark.createDataFrame([(r["source"], r["length"], r["modified"]) for r in some],
                                      "source string, length long, modified timestamp")
        states = file_states(data.withColumn("_source", F.col("_metadata.file_path")), columns, "_source")
        # a file without rows has a state too, or it would be new each time
        seen = facts.join(states, "source", "left").withColumns({
            "column_name": F.coalesce("column_name", F.lit("")), "rows": F.coalesce("rows", F.lit(0)),
            "nulls": F.coalesce("nulls", F.lit(0))})
        seen.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("append").parquet(state_path)
    return len(new)


def profile_of(states: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, min_value, max_value, distinct_values,
    distinct_ratio, low_cardinality) of all files together. Distinct values are
    estimated and at most the rows; the flag is for a ratio below a half, and
    of no rows false."""
    all_files = (states.where(F.col("column_name") != "").groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_n")))
    n = F.least(F.coalesce("_n", F.lit(0)), F.col("rows") - F.col("nulls"))
    ratio = F.when(F.col("rows") > 0, F.col("distinct_values") / F.col("rows"))
    return (all_files.withColumn("distinct_values", n).drop("_n")
            .withColumn("distinct_ratio", ratio)
            .withColumn("low_cardinality", F.coalesce(F.col("distinct_ratio") < 0.5, F.lit(False))))
