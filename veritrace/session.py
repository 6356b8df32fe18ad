"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a cluster alike. Partition counts are
# left to adaptive execution, which starts from `initial` and merges down.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, app: str = "veritrace", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    shuffle = cpus if str(cpus).isdigit() else 8
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on, for sessions made elsewhere.

    Spark 4.1 takes a union of two sides with equal hash partitioning as
    partitioned, but adaptive execution may merge the partitions of the two
    sides differently; a grouping on top then splits keys. Times are UTC.
    """
    for key in ("spark.sql.unionOutputPartitioning", "spark.sql.session.timeZone"):
        spark.conf.set(key, BASE_CONF[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset (a
    local test session) is a folder made, and it is recorded in the session so
    all later calls agree.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="spark-veritrace-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/veritrace/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives executor loss, and makes sure a
    provider call upstream runs once per row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
