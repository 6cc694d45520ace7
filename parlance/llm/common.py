"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

import parlance
from parlance.session import ensure_checkpoint_dir
from parlance.sources.tables import read_table

#: Bytes that separate words in every contract of this package: space and 0x09-0x0D.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Documents per slice inside one Arrow batch, so Python holds few texts at a time.
SLICE = 256


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table, pruned to ``columns``."""
    return read_table(spark, sf_dir, "documents", *columns)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: later stages, and tasks that rerun after a lost executor, read
    the files instead of repeating the work above.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches, size: int = SLICE) -> Iterator:
    """Cut Arrow record batches into slices of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (``addPyFile``), once per Spark application.

    Workers import it as a module, so what a module caches lasts as long as the worker.
    """
    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(parlance.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-code-"), "parlance_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(parlance.__file__))):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    archive.write(at, os.path.relpath(at, top))
    context.addPyFile(path)
    context._parlance_shipped = True


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
