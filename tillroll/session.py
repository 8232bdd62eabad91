"""Spark session and shared-storage helpers.

Everything in the library takes a ``SparkSession`` and returns lazy
DataFrames; this module only builds sessions for tests / bench and finds
the shared folder used to cut lineage or stage intermediate tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def split_bytes_for(input_bytes: int, cores: int, floor: int = 1 << 20,
                    ceiling: int = 128 << 20) -> int:
    """Input split size giving every core about two splits, within
    [1 MiB, 128 MiB]: small inputs still use all cores, big inputs keep the
    usual 128 MiB splits (fewer, larger tasks)."""
    return max(floor, min(ceiling, input_bytes // max(1, 2 * cores)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tillroll", max_partition_bytes: int | None = None) -> SparkSession:
    """Session for tests and the local bench. A cluster supplies its own."""
    builder = SparkSession.builder
    if max_partition_bytes:
        builder = builder.config("spark.sql.files.maxPartitionBytes", str(max_partition_bytes))
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode
    session (tests, bench) without one gets a private folder; a cluster
    session without one is an error rather than a machine-local fallback.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) session: the server owns the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the server") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # Executors on other machines cannot read a driver-local folder.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) "
                               "for this cluster")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tillroll-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
