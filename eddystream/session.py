"""Session helpers: Python workers must find this package wherever they run, and tables are kept in the shared folder.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir``
names, so a lost executor only costs the tasks that it ran. The setting is read
from the session; a folder of our own is used only where it is unset and all
runs on one machine. Tables there are deleted when the session ends, or before.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/eddystream"


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors once a session, so that nothing has to be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_eddystream_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "eddystream_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._eddystream_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session over several machines has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """``path`` and its file system, as the JVM has them."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/eddystream-{label}-{uuid.uuid4().hex}"
    target, files = _hadoop(spark, path)
    files.mkdirs(target)  # only what exists can be marked
    files.deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, without its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._eddystream_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by :func:`stored` that nothing reads any more, and the shuffle files of plans that are gone."""
    path = getattr(df, "_eddystream_path", None)
    if path:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()  # Spark's cleaner removes what no live plan refers to
        target, files = _hadoop(df.sparkSession, path)
        files.delete(target, True)
        files.cancelDeleteOnExit(target)
