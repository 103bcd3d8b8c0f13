"""Versioned snapshots under one folder, committed optimistically.

``data/<id>`` holds the files of one snapshot, ``manifest/<version>`` names it. A writer says which version it
started from and commits the next number by renaming its manifest into place, which fails if another writer
has taken that number: of two writers one commits and the other gets a ``CommitConflict`` and leaves nothing
behind. Readers see the newest manifest or ask for an older version. The rename is the only step that needs
the store's help; it must refuse an existing target, as the Hadoop file systems with an atomic rename do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed since the version this one started from."""


def _files(spark: SparkSession, root: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(conf)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions in order: one small file each, as many as ``expire`` leaves."""
    path, fs = _files(spark, root)
    folder = path(f"{root}/manifest")
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())


def latest(spark: SparkSession, root: str) -> int:
    """The newest version, 0 before the first."""
    return max(versions(spark, root), default=0)


def _data(spark: SparkSession, root: str, version: int) -> str:
    return spark.read.text(f"{root}/manifest/{version:012d}").first()[0]


def _put(spark: SparkSession, root: str, version: int, data: str) -> None:
    path, fs = _files(spark, root)
    jvm = spark.sparkContext._jvm
    draft, final = path(f"{root}/draft/{uuid.uuid4().hex}"), path(f"{root}/manifest/{version:012d}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(data.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(final):
            raise CommitConflict(f"version {version} of {root} is taken") from error
        raise


def commit(df: DataFrame, root: str, started_from: int) -> int:
    """Write ``df`` as the version after ``started_from`` and return its number."""
    spark = df.sparkSession
    if latest(spark, root) != started_from:
        raise CommitConflict(f"{root} is at version {latest(spark, root)}, not {started_from}")
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{data}")
    try:
        _put(spark, root, started_from + 1, data)
    except BaseException:
        path, fs = _files(spark, root)
        fs.delete(path(f"{root}/{data}"), True)
        raise
    return started_from + 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest snapshot, or an older version that ``expire`` has left."""
    number = latest(spark, root) if version is None else version
    if number not in versions(spark, root):
        raise LookupError(f"{root} has no version {number}")
    return spark.read.parquet(f"{root}/{_data(spark, root, number)}")


def roll_back(spark: SparkSession, root: str, version: int, started_from: int) -> int:
    """Make an older version the newest one again: a new manifest over the same files."""
    if version not in versions(spark, root):
        raise LookupError(f"{root} has no version {version}")
    _put(spark, root, started_from + 1, _data(spark, root, version))
    return started_from + 1


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all but the newest ``keep`` versions, and the files that no manifest names any more."""
    path, fs = _files(spark, root)
    known = versions(spark, root)
    used = {_data(spark, root, v).rsplit("/", 1)[1] for v in known[-keep:]}
    old = {_data(spark, root, v).rsplit("/", 1)[1] for v in known[:-keep]}
    for v in known[:-keep]:
        fs.delete(path(f"{root}/manifest/{v:012d}"), False)
    for name in old - used:
        fs.delete(path(f"{root}/data/{name}"), True)
    return len(old - used)
