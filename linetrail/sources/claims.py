"""Small marker files in the shared folder: which generation numbers are taken, and which numbers of buckets are in use.

A file that must not exist yet is created by exactly one of several writers, on file systems whose create is atomic (HDFS and most
stores; local files by the operating system's own call).  The driver touches a few file names; no data passes here.  Uses the session's JVM for
the file system, so it needs a classic session, not Spark Connect.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _path(spark, folder)
    try:
        return [s.getPath().getName() for s in fs.listStatus(path)]
    except Py4JJavaError as e:
        if "FileNotFoundException" in e.java_exception.getClass().getName():
            return []
        raise


def has_data(spark: SparkSession, folder: str) -> bool:
    """Whether anything but marker files has been written to a folder."""
    return any(n[0] not in "_." for n in _names(spark, folder))


def create_new(spark: SparkSession, at: str, content: str = "") -> bool:
    """Create a file that must not exist; false if it does."""
    fs, path = _path(spark, at)
    fs.mkdirs(path.getParent())
    if path.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile() and (not content or _write(fs, path, content, True))
    try:
        return _write(fs, path, content, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def _write(fs, path, content: str, replace: bool) -> bool:
    out = fs.create(path, replace)
    out.write(bytearray(content.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, at: str) -> str | None:
    """The content of a marker file, or None without one."""
    fs, path = _path(spark, at)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readNBytes(1 << 16)).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def generations(spark: SparkSession, root: str) -> list[int]:
    """The writes that have a folder, newest first."""
    return sorted((int(n[11:]) for n in _names(spark, root) if n.startswith("generation=")), reverse=True)


def claim_generation(spark: SparkSession, root: str) -> int:
    """The next generation of the index at ``root``: one more than the largest that was claimed or written.  Whoever creates its
    file has it; the others try the next number.  The files of smaller numbers are removed."""
    folder = f"{root}/_claims"
    claimed = [int(n) for n in _names(spark, folder) if n.isdigit()]
    number = max([0, *claimed, *generations(spark, root)]) + 1
    while not create_new(spark, f"{folder}/{number:020d}"):
        number += 1
    for old in claimed:
        fs, path = _path(spark, f"{folder}/{old:020d}")
        fs.delete(path, False)
    return number


def mark_layout(spark: SparkSession, root: str, n_buckets: int) -> None:
    create_new(spark, f"{root}/_layouts/{int(n_buckets)}")


def layouts(spark: SparkSession, root: str) -> list[int]:
    """The numbers of buckets that tables at ``root`` were written with."""
    return sorted(int(n) for n in _names(spark, f"{root}/_layouts") if n.isdigit())
