"""Small files that are written once: the points at which written data becomes visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def store_of(spark: SparkSession, path: str):
    """Client of the store that ``path`` lies on."""
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return store_of(spark, path).exists(hadoop_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder. Hidden ones (``.``) are left out."""
    if not exists(spark, folder):
        return []
    found = store_of(spark, folder).listStatus(hadoop_path(spark, folder))
    return sorted(n for n in (status.getPath().getName() for status in found) if not n.startswith("."))


def remove(spark: SparkSession, path: str) -> None:
    store_of(spark, path).delete(hadoop_path(spark, path), True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file; the folder of its new name is made where it is missing."""
    store, target = store_of(spark, path), hadoop_path(spark, to)
    store.mkdirs(target.getParent())
    if not store.rename(hadoop_path(spark, path), target):
        raise OSError(f"{path} can't become {to}")


def read_once(spark: SparkSession, path: str) -> dict:
    """Content of a file that ``create_once`` has written."""
    stream = store_of(spark, path).open(hadoop_path(spark, path))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Writes a small file whole, unless there is one: True for the one writer that has created it.

    The content goes to a hidden file beside it, which a rename that refuses to replace then puts in place; so
    readers see all of it or nothing, and of two writers one is told that it came second.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if exists(spark, path):
        return False
    stream = store_of(spark, path).create(hadoop_path(spark, draft), False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    target = hadoop_path(spark, path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else store_of(spark, path).getUri(), conf)
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(hadoop_path(spark, draft), target, keep)
    except Exception as refused:
        remove(spark, draft)
        if "FileAlreadyExistsException" not in str(refused):
            raise
        return False
    return True
