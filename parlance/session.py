"""Spark session settings used by tests, the bench and local runs.

On a cluster the session is created by the platform; these helpers only fill in
settings that are unset, so cluster-level choices (shuffle partitions, checkpoint
folder, AQE thresholds) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on.  AQE re-plans joins from runtime
# sizes, coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "parlance", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when a local session names none (tests) a scratch folder is created; on a
    cluster the setting must point at shared storage, and its absence is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        current = tempfile.mkdtemp(prefix="parlance-ckpt-", dir=os.environ.get("PARLANCE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder and read again.

    For a frame that a plan reads several times: it is computed once, its lineage ends at
    the files, and a join on it shuffles directly above the scan, so AQE can split a hot key.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (``addPyFile``), once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-code-"), "parlance_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    archive.write(at, os.path.relpath(at, os.path.dirname(package)))
    context.addPyFile(path)
    context._parlance_shipped = True


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
