"""Session helpers: local session, shared work folders, table reading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []  # temporary folder of this process, once needed


def local_session(
    cores: str | int = "*", app_name: str = "civilspark", shuffle_partitions: int = 8
) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitter brings one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    The setting is required where executors are processes of their own, since they must
    see the folder.  Where driver and executors are one process and it is unset, as in
    tests, a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="civilspark-"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/civilspark/{purpose}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(
    df: DataFrame, purpose: str, batch_rows: int | None = None, group_bytes: int | None = None
) -> DataFrame:
    """Write a table that several later passes read, and read it back.

    The written table cuts the lineage and outlives lost executors.  With ``batch_rows``,
    Python steps of this write get that many rows at a time: a batch lies in the JVM, on
    its way and in the worker at once, which for long texts is much memory.  ``group_bytes``
    bounds the row groups, each of which lies whole in the memory of its writer and reader.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(ARROW_ROWS)
    smaller = batch_rows is not None and not 0 < int(before) <= batch_rows
    if smaller:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    try:
        writer.parquet(path)
    finally:
        if smaller:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.parquet(path)
