"""Session helpers: table access, parallelism and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "tessera", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none and the master is local (tests on one machine) is a
    temporary folder set; a cluster without the setting is refused.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage and survives the loss of executors: later reads come from the
    shared files, never from executor-local blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, waves: int = 2) -> int:
    """Partitions for CPU-bound Python stages: follows the configured shuffle width, never below a few waves of tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), waves * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, waves: int = 2) -> DataFrame:
    """``df`` in enough partitions for CPU-bound Python work: a scan that already fills all cores stays as it is, without a shuffle."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df.repartition(width(spark, waves))
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(width(spark, waves))
