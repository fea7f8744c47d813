"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on or profits from; all can be set at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # REBALANCE hints split hot partitions instead of writing them in one task.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else started."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(
    cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use `configure`."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearpass")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in
    `spark.checkpoint.dir`.

    A local session without that setting gets a folder of its own, removed when
    the program ends; on a cluster a missing setting is an error, as the
    executors' own folders cannot be read by each other.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = tempfile.TemporaryDirectory(prefix="nearpass-")
        folder = _own_folders[application].name
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run inside the shared one."""
    return f"{shared_folder(spark)}/nearpass-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The same rows out of a table written to the shared folder.

    Cuts a plan that several branches would each compute anew; the table is
    there for every executor and outlives any of them.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly for work that is heavy per row, whatever the splits of their table."""
    return df.hint("rebalance")
