"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that the plans rely on; all of them are ordinary Spark options.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # fits of several trials and horizons run side by side
    "spark.scheduler.mode": "FAIR",
    # no stack trace per Column expression: plans with dozens of columns build much faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tapewright", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, which may not have it on their path."""
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    Where the setting is absent a local master (tests) gets a temporary folder of this
    machine; on a cluster that would lose rows, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.environ.get("TAPEWRIGHT_LOCAL_STAGE")
    if not root:
        root = tempfile.mkdtemp(prefix="tapewright-")
        os.environ["TAPEWRIGHT_LOCAL_STAGE"] = root
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage: what several later jobs read is computed once, and survives lost
    executors because it lies in shared storage.
    """
    path = stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
