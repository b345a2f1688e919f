"""Small files in the tables' file system: markers, claims and lists, whatever store it is."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def children(spark: SparkSession, folder: str) -> list[tuple[str, int, bool]]:
    """Name, time of the last change in milliseconds, and whether it is a folder, of what lies
    directly in a folder; none if it isn't there. Files that writers keep aside are left out."""
    system, found = _open(spark, folder)
    try:
        inside = list(system.listStatus(found))
    except Py4JJavaError as error:
        if "FileNotFound" not in error.java_exception.getClass().getName():
            raise
        return []
    rows = [(s.getPath().getName(), s.getModificationTime(), s.isDirectory()) for s in inside]
    return sorted(row for row in rows if not row[0].startswith(("_", ".")))


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """All files below a folder, by their path from there, and when each was last changed."""
    out = []
    for name, changed, is_folder in children(spark, folder):
        if is_folder:
            out += [(f"{name}/{path}", at) for path, at in listed(spark, f"{folder}/{name}")]
        else:
            out.append((name, changed))
    return out


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file that is not there yet, with some text; False if somebody else was first."""
    system, found = _open(spark, path)
    try:
        stream = system.create(found, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    system, found = _open(spark, path)
    stream = system.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    system, found = _open(spark, path)
    system.delete(found, True)
