"""Written tables in the shared folder that all executors and the driver can reach.

Cutting lineage goes through Parquet here, never through a local checkpoint: a lost executor
then costs a re-read, not a recomputation of everything upstream. Tables stay until the application
ends, or until ``clear``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
#: Bytes of a Parquet row group: writers hold one in memory, and a stage's results are only read once or twice.
_ROW_GROUP = 32 << 20
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _OWN_DIR


def application_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        fs, target = file_system(spark, path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _MARKED.add(path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the application's folder that nothing else uses."""
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has written; results that still read them can't be read any more."""
    path = application_dir(spark)
    remove(spark, path)
    _MARKED.discard(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def arrow_file_system(path: str):
    """The file system of a path as Arrow sees it, from whatever machine this runs on, and the path there."""
    from pyarrow import fs

    # The path of a URI would be unescaped, and Hadoop's paths are not escaped: only what stands before it is one.
    before, place = re.match(r"((?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?)(.*)", path, re.S).groups()
    if before in ("", "file:", "file://"):
        return fs.LocalFileSystem(), place
    system, root = fs.FileSystem.from_uri(f"{before}/")
    return system, root.rstrip("/") + place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system API."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Give a written file or folder its name in one step, unless the name is taken; whether it was given.

    The loser of a race is deleted, so nothing half-written ever has the name.
    """
    jvm = spark._jvm
    fs, old = file_system(spark, source)
    _, new = file_system(spark, target)
    fs.mkdirs(new.getParent())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(old, new, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        fs.delete(old, True)
        if fs.exists(new):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a manifest."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file; FileExistsError if there is one."""
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    fs, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []
