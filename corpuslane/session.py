"""Session, table loading and the few runtime decisions shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: Python workers import it by name,
    wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}-core.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "corpuslane", master: str | None = None) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master[master.find("[") + 1 : -1] if "[" in master else ""
        parts = cores if cores.isdigit() else str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", parts)
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder is whatever ``spark.checkpoint.dir`` names. A session on one machine without the
    setting gets a local folder; a cluster without it is an error, since executors would write to
    their own disks and later reads would miss files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a durable lineage cut that
    survives lost executors and stops a shared subplan from running twice."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan with fewer splits than cores before CPU-heavy text work.

    A table with many row groups already fills the cluster and passes through
    untouched, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def deal(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Deal rows out by ``keys`` over the cores, over the session's shuffle partitions or over ``least`` tasks, whichever are more.

    For short rows with much work in each: by bytes, AQE and the scan leave millions of them to one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), least), *keys)


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
