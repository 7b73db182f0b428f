"""Spark session settings shared by entry points, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(cpus: int | None = None, app: str = "weftline", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE on, few shuffle partitions."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table as a DataFrame (column pruning and filters reach the scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df, kind: str):
    """``df`` written to a folder of its own and read again, for what is costly and read more than once."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_out(df):
    """The rows of ``df`` in as many parts as a shuffle has, for work that costs far more than its input's bytes tell: files are
    split by size, so a small file of many rows is one task's. The number is given, or adaptive plans join small parts again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


SHARED: list[str] = []  #: folders named by this driver, for remove_shared


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one machine sets its own and a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints/weftline"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under spark.checkpoint.dir."""
    SHARED.append(f"{_root(spark)}/{kind}-{uuid.uuid4().hex}")
    return SHARED[-1]


def named_folder(spark: SparkSession, name: str) -> str:
    """The folder of that name under spark.checkpoint.dir, the same for every driver; it stays until somebody deletes it."""
    return f"{_root(spark)}/{name}"


def remove_shared(spark: SparkSession) -> None:
    """Delete every folder that shared_folder() has named. Results are lazy and read them, so the caller does this once the
    results have been written."""
    while SHARED:
        path = spark._jvm.org.apache.hadoop.fs.Path(SHARED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
