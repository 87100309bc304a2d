"""Shared helpers: shipping this package, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per application.

    Worker functions are pickled by reference, so executors need the modules.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="tidemark-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"tidemark_{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master (tests on one
    machine); any other master has no such folder, and this raises.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not folder:
        folder = getattr(sc, "_tidemark_folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._tidemark_folder = folder
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system that Spark writes to."""
    files, at = _hadoop_path(spark, path)
    files.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    What is written goes with the application, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _hadoop_path(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            delete(df.sparkSession, path)
