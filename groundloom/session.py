"""Session helpers shared by the bench, the tests and the sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "groundloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session (tests, laptops) may do without and then gets a temporary
    folder of its own; executors elsewhere would not see one of the driver's.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="groundloom-"))
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and later uses recompute nothing."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table stored in fewer splits than there are cores before heavy work on its rows.

    A table of ordinary size has many splits and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
