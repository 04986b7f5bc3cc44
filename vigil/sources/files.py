"""Small files and names on whatever file system a path is on, through Hadoop."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs


def file_system(spark: SparkSession, path: str):
    return _hadoop(spark).Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return bool(file_system(spark, path).exists(_hadoop(spark).Path(path)))


def names(spark: SparkSession, path: str) -> Iterator[tuple[str, int]]:
    """Name and time of change (ms) of what a folder holds; nothing if there is no such folder."""
    if exists(spark, path):
        found = file_system(spark, path).listStatusIterator(_hadoop(spark).Path(path))
        while found.hasNext():
            status = found.next()
            yield status.getPath().getName(), status.getModificationTime()


def read_text(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(_hadoop(spark).Path(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    stream = file_system(spark, path).create(_hadoop(spark).Path(path), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step; False if the target is there already."""
    fs = _hadoop(spark)
    there = fs.Path(target)
    context = fs.FileContext.getFileContext(file_system(spark, target).makeQualified(there).toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.NONE
    try:
        context.rename(context.makeQualified(fs.Path(source)), context.makeQualified(there), options)
    except Exception as error:
        if "FileAlreadyExists" in str(getattr(error, "java_exception", error)):
            return False
        raise
    return True
