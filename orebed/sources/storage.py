"""Folders and files by the file system that Spark itself uses, whatever the scheme."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    configuration = spark._jsparkSession.sessionState().newHadoopConf()
    return hadoop_path.getFileSystem(configuration), hadoop_path


def _hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/") if "=" not in part)


def files_below(spark: SparkSession, path: str) -> Iterator[tuple[str, int]]:
    """(path, time of writing) of the files below ``path``, which may be a pattern; one after
    another as the store names them, so whoever needs few reads few. Hidden ones are left out."""
    system, pattern = _file_system(spark, path)
    for root in system.globStatus(pattern) or []:
        prefix = root.getPath().toString()
        listed = system.listFiles(root.getPath(), True)
        while listed.hasNext():
            status = listed.next()
            name = status.getPath().toString()
            if not _hidden(name[len(prefix) :]):
                yield name, status.getModificationTime()


def has_files(spark: SparkSession, path: str, pattern: str | None = None) -> bool:
    """Whether ``path`` holds a file whose name matches ``pattern``; stops at the first."""
    return any(
        pattern is None or fnmatchcase(name.rsplit("/", 1)[-1], pattern)
        for name, _ in files_below(spark, path)
    )


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders directly in ``path``; none if it does not exist."""
    system, pattern = _file_system(spark, f"{path}/*")
    found = system.globStatus(pattern) or []
    return sorted(s.getPath().toString() for s in found if s.isDirectory())


def written_at(spark: SparkSession, path: str) -> int:
    """When the last file below ``path`` was written, in milliseconds; the folder's own time if
    it has none."""
    system, hadoop_path = _file_system(spark, path)
    newest = system.getFileStatus(hadoop_path).getModificationTime()
    return max([newest, *(at for _, at in files_below(spark, path))])


def delete_folder(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _file_system(spark, path)
    system.delete(hadoop_path, True)


def same_place(left: str, right: str) -> bool:
    """Whether two names are of one folder, or the first lies in the second."""
    left, right = (p.split(":", 1)[-1].replace("///", "/").rstrip("/") for p in (left, right))
    return left == right or left.startswith(f"{right}/")
