"""Session settings the library relies on, and the shared folder for lineage cuts."""

from __future__ import annotations

import importlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Naive stamps are read as UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a model answer keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's join even where the next aggregate then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send the named packages to the executors, each once per application.

    For sessions started without ``--py-files`` on machines where the packages are not installed:
    code inside tasks imports them.
    """
    context = spark.sparkContext
    for package in packages:
        if (context.applicationId, package) in _shipped:
            continue
        archive = os.path.join(tempfile.mkdtemp(prefix="sigmill-code-"), f"{package}-code.zip")
        root = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        _shipped.add((context.applicationId, package))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. A temporary folder is only ever used by a
    local session: on a cluster an executor could not read it back.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if root is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="sigmill-checkpoint-")
    if current is None:
        spark.sparkContext.setCheckpointDir(root)
    return root or current


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/sigmill-{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """The frame written down in the shared folder and read back.

    The result outlives lost executors and has no lineage to replay. A columnar table rather than
    a row checkpoint: later passes read only the columns and row groups they need.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame returned by ``cut`` once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/sigmill-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
