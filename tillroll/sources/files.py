"""File sources and sinks: format dispatch, marts, listings.

Paths are any Hadoop path (``s3a://``, ``hdfs://``, local); credentials and
endpoints are Spark/Hadoop configuration, not code.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_currency_columns, month_number

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}
# Doubled quotes inside a quoted CSV value, as spreadsheets write them.
CSV_QUOTING = {"quote": '"', "escape": '"'}


def format_of(path: str) -> str:
    ext = path.rstrip("/").lower().rsplit(".", 1)[-1]
    try:
        return FORMATS[ext]
    except KeyError:
        raise ValueError(f"unsupported file type {ext!r} for {path}") from None


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None, multiline: bool = False, text: bool = False) -> DataFrame:
    """Read a table, choosing the reader from the extension (or ``fmt``).

    CSV is read with a header and UTF-8. With a schema, CSV columns are
    matched by header *name* (read as text, then cast; absent columns become
    typed NULLs), so files with fewer or reordered columns load correctly and
    no inference pass runs. Without a schema the types are inferred, or all
    columns are text with ``text``. Quoted values may hold commas and doubled
    quotes; values with line breaks need ``multiline``, which makes each file
    one task. A
    missing path raises ``FileNotFoundError``; other reader errors propagate.
    """
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8") \
            .options(**CSV_QUOTING).option("multiLine", multiline) \
            .option("inferSchema", schema is None and not text)
    elif schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if fmt == "csv" and schema is not None:
        df = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None))
                         .cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


#: Largest table that :func:`spread_small` deals out.
SMALL_BYTES = 256 << 20


def spread_small(df: DataFrame, key: str, at_most: int = SMALL_BYTES) -> DataFrame:
    """``df``, a table as read from files, dealt out by ``key`` if it is small.

    A row group is read by one task, and a small table often is one: all that
    follows up to the next exchange would then run in a single task. Tables of
    more bytes than ``at_most`` have row groups enough and stay as they are,
    so nothing large is moved. The size is that of the files, known to the
    plan without reading them."""
    if not hasattr(df, "_jdf"):  # a remote (Connect) session shows no plan; the table stays as it is
        return df
    size = int(str(df._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2, cores), key) if size <= at_most else df


#: File bytes of the part of a large table that one task joins or groups.
PART_BYTES = 16 << 20


def leaf_bytes(df: DataFrame) -> list[int]:
    """Bytes of the tables that ``df`` reads, the leftmost first, as the plan
    knows them without reading; tables of unknown size are left out, and a
    remote (Connect) session knows none."""
    if not hasattr(df, "_jdf"):
        return []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return [n for n in sizes if n < 1 << 60]  # Spark's mark of an unknown size is the largest long


def spread_large(df: DataFrame, key: str, other: DataFrame, at_least: int = SMALL_BYTES,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` dealt out by ``key`` in parts by the bytes of its leftmost table,
    if that is large and the join with ``other`` on ``key`` deals it out anyway.

    Left to the join, the number of parts is the session's, or parts are glued
    together by their compressed bytes, and what a task sorts and groups grows
    with the table. An ``other`` small enough to be broadcast leaves ``df`` as
    it is."""
    mine, theirs = leaf_bytes(df)[:1], leaf_bytes(other)[:1]
    if not mine or mine[0] <= at_least or not theirs:
        return df
    broadcast = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.repartition(-(-mine[0] // part_bytes), key) if theirs[0] > broadcast else df


@contextmanager
def partitions_for(df: DataFrame, part_bytes: int = PART_BYTES):
    """While it lasts, shuffles of the session have at least a partition for
    every ``part_bytes`` that ``df`` reads: for writing the groups of a frame
    that may have as many as lines."""
    spark, name = df.sparkSession, "spark.sql.shuffle.partitions"
    before, wanted = spark.conf.get(name), -(-sum(leaf_bytes(df)) // part_bytes)
    if wanted <= int(before):
        yield
        return
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """``df``, as read from files, with the path of each row's file."""
    return df.withColumn(name, F.input_file_name())


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a table (CSV with a header, no index); Parquet by default."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).options(**CSV_QUOTING)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_mart(df: DataFrame, path: str, fmt: str = "parquet",
               partition_by: list[str] | None = None) -> str:
    """Write a mart, replacing what is there (CSV with a header, no index;
    Parquet by default, optionally partitioned, e.g. by year)."""
    return write_table(df, path, fmt, mode="overwrite", partition_by=partition_by)


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the path's own filesystem (through the
    data source API when the session has no JVM gateway, e.g. Connect)."""
    try:
        fs, p = _fs_path(spark, path)
    except Exception:  # noqa: BLE001
        try:
            spark.read.format("binaryFile").load(path).schema  # resolves the path
            return True
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return False
            raise
    return bool(fs.exists(p))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files under ``path`` (recursive, complete listing) with size and
    modification time; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def is_complete(spark: SparkSession, path: str) -> bool:
    """A written table counts as present only once its job committed (the
    committer's ``_SUCCESS`` marker); a folder left by a failed or
    interrupted write is treated as absent."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def ensure_mart(spark: SparkSession, path: str, build, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> dict:
    """Materialise a mart only if it is absent: returns the status
    ('exists' / 'processed') and the path. ``build`` is a zero-argument
    callable returning the DataFrame, so nothing is computed when it exists.
    An incomplete earlier attempt is overwritten."""
    if is_complete(spark, path):
        return {"status": "exists", "file": path}
    write_table(build(), path, fmt, mode="overwrite", partition_by=partition_by)
    return {"status": "processed", "file": path}


def load_mart(spark: SparkSession, path: str, schema: T.StructType,
              fmt: str = "parquet") -> DataFrame:
    """Read a mart with a fixed schema (``year`` as text); a typed empty
    frame when it does not exist yet."""
    if not is_complete(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        df = read_table(spark, path, schema, fmt)
    else:
        # Declared schema: no inference, and a committed empty mart loads too.
        df = spark.read.format(fmt).schema(schema).load(path)
    if "year" in df.columns:
        df = df.withColumn("year", F.col("year").cast("string"))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


MONTHLY_SHEET_NUMERIC = ["MTD SALES", "MTD BILLS", "MTD ABV"]


def preprocess_monthly_sheet(sheet: DataFrame) -> DataFrame:
    """Pre-aggregated monthly sheet: Year as text, currency text in the
    three measures cleaned to numbers, and a month number (0 if unknown)."""
    out = sheet.withColumn("Year", F.col("Year").cast("string"))
    out = clean_currency_columns(out, MONTHLY_SHEET_NUMERIC, T.DoubleType())
    return out.withColumn("Month_Num", month_number("Month"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-update by key: columns that the incoming rows carry win over
    the stored ones, also with NULL; stored columns that they lack stay, and
    columns that only they have are added (NULL on other rows). Of several
    rows of one side with one key the largest by value, in column order, is
    taken.

    One aggregation on the key: it combines map-side, so a hot key never
    gathers its rows in one place. The result is meant to be written to a new
    path (never over its own input).
    """
    stored = [c for c in current.columns if c not in keys]
    sent = [c for c in incoming.columns if c not in keys]
    side = lambda df, cols, name, other, others: df.select(
        *keys, F.struct(F.lit(1).alias("_here"), *cols).alias(name),
        F.lit(None).cast(other.select(F.struct(F.lit(1).alias("_here"), *others)).schema[0].dataType)
        .alias("_new" if name == "_old" else "_old"))
    both = side(current, stored, "_old", incoming, sent).unionByName(
        side(incoming, sent, "_new", current, stored))
    merged = both.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    value = lambda c: (F.col(f"_old.{c}") if c not in sent else F.col(f"_new.{c}") if c not in stored
                       else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")))
    return merged.select(*keys, *[value(c).alias(c) for c in [*stored, *[c for c in sent if c not in stored]]])


@dataclass
class SalesData:
    """Lazy bundle of the two inputs of the dashboard."""

    sales: DataFrame
    calendar: DataFrame


def load_all(spark: SparkSession, sales_path: str, calendar_path: str | None = None,
             raw_schema: T.StructType | None = None, dates_by_file: bool = False, day_first=None) -> SalesData:
    """Read and normalise the sale lines and the holiday calendar. With
    ``dates_by_file`` the order of day and month is decided file by file (see
    ``normalize_sales``)."""
    from ..functions.clean import normalize_sales, with_calendar_parts
    from ..operators.holidays import default_calendar, read_calendar
    from ..schemas import RAW_SALES_TEXT
    raw = read_table(spark, sales_path, raw_schema or RAW_SALES_TEXT)
    if dates_by_file:
        sales = normalize_sales(with_file(raw), "source_file", day_first)
    else:
        sales = normalize_sales(raw)
    calendar = read_calendar(spark, calendar_path) if calendar_path else default_calendar(spark)
    return SalesData(with_calendar_parts(sales), calendar)
