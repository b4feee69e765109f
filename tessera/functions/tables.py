"""Intermediate tables in the shared folder, and the package's own code on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors see; removed when the application ends.

    Where the setting is absent and everything runs in one process, as in tests, a temporary folder is set and used. On a
    cluster its absence is an error: a folder of one machine would be another one on each executor.
    """
    context = spark.sparkContext
    if context not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
            spark.conf.set("spark.checkpoint.dir", base)
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/tessera-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _ROOTS[context] = root
    return _ROOTS[context]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None, rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, and a
    lost executor costs nothing but its running tasks.

    ``rows`` is how many go to a file at most (0: any number). Spark's reader decodes up to 4,096 rows of a file at once, so
    a table whose rows take megabytes needs files of few rows.
    """
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled, never broadcast: Spark's guess of a size doesn't see what an explode multiplies
    nor what Parquet's dictionaries hide, and a broadcast is built on the driver."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, for the steps that run Python there."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.TemporaryDirectory(prefix="tessera-code-")
    archive = os.path.join(folder.name, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(archive)
    _SHIPPED[context] = folder  # kept while the application may ask for it


#: Rows go to Python in batches of so many bytes, unless the session's settings say otherwise than the default does.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, "1") == BATCH_DEFAULT and not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
