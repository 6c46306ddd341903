"""Session helpers: a local session for tests/bench, and the lineage cut.

On a cluster the session comes from the platform; ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from it and only sets one when it is unset (local
tests), never a machine-local folder on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cluster_conf(executors: int = 1000, cores_per_executor: int = 5) -> dict:
    """Settings this library is written for on a large cluster: AQE re-plans
    joins and coalesces/splits partitions at run time, skewed join partitions
    are split, scans read ~256 MB splits, and the initial shuffle width covers
    about three tasks per core (AQE coalesces what is too small).
    ``spark.checkpoint.dir`` must name a folder every executor shares."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(3 * executors * cores_per_executor),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "epicohort") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EPICOHORT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create a scratch one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: stage tables need a folder every executor "
                           "shares (e.g. HDFS or an object store); a machine-local folder would not survive "
                           "executor loss")
    path = tempfile.mkdtemp(prefix="epicohort-ckpt-")
    sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``epicohort`` importable in the Python workers (``mapInPandas``
    stages pickle functions and classes of this package by reference): zip the
    package once per SparkContext and hand it to ``addPyFile``, which sends it
    to every executor."""
    import zipfile

    import epicohort
    sc = spark.sparkContext
    if getattr(sc, "_epicohort_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(epicohort.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="epicohort-pkg-"), "epicohort.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._epicohort_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
