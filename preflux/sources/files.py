"""Small files (pointers, sessions, reports) on whatever store a path names, through Spark's file systems.

A path without a scheme means the session's default file system, as it does for
``spark.read``, so pointers and the tables that they point at stay together.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(path: str):
    spark = SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.sparkContext._jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    _, store, at = _open(path)
    return store.exists(at)


def read_text(path: str) -> str:
    jvm, store, at = _open(path)
    stream = store.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Written whole, in place of a file that is there."""
    _, store, at = _open(path)
    stream = store.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def names(folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    _, store, at = _open(folder)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def walk(folder: str) -> list[str]:
    """Paths of all files below a folder, relative to it, sorted; none where there is no folder."""
    _, store, at = _open(folder)
    if not store.exists(at):
        return []
    top, found, listed = store.makeQualified(at).toUri().getPath().rstrip("/") + "/", [], store.listFiles(at, True)
    while listed.hasNext():
        found.append(listed.next().getPath().toUri().getPath().removeprefix(top))
    return sorted(found)


def remove(path: str) -> None:
    """With all that is below it; nothing happens where there is nothing."""
    _, store, at = _open(path)
    store.delete(at, True)
