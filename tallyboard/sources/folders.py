"""Files of the cluster's own file systems: markers, moves and removals."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system that a path belongs to, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def children(spark: SparkSession, path: str) -> list[tuple[str, datetime]]:
    """Names in a folder with the time they were last changed; none where there is no folder."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return []
    return [
        (status.getPath().getName(),
         datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc))
        for status in system.listStatus(place)
    ]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that is in it; nothing happens where there is none."""
    system, place = _at(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder; False, and nothing moved, where ``to`` is there already."""
    system, place = _at(spark, path)
    target = _at(spark, to)[1]
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(place, target)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; whether it was written."""
    system, place = _at(spark, path)
    if system.exists(place):
        return False
    try:
        stream = system.create(place, False)
    except Exception:
        # Somebody else made the file in the meantime; anything else is an error.
        if system.exists(place):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
