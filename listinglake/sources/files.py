"""Small files that say what a table consists of, through the file system that Spark reads it with."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, hidden files left out; nothing where there is no folder."""
    place, system = _at(spark, folder)
    if not system.exists(place):
        return []
    return sorted(n for s in system.listStatus(place) if not (n := s.getPath().getName()).startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers k of a folder's parts ``name=k``."""
    return sorted(int(n.partition("=")[2]) for n in names(spark, folder) if n.startswith(f"{name}="))


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _at(spark, path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file appear whole, unless there is one already; says whether it did.

    The text is written aside first. A local disk links it to its name, which fails where the name
    is taken; elsewhere it is renamed, which takes a store that does not rename onto an existing file.
    """
    place, system = _at(spark, path)
    aside, _ = _at(spark, f"{place.getParent()}/.{uuid.uuid4().hex}")
    system.mkdirs(place.getParent())
    stream = system.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getScheme() == "file":
            os.link(aside.toUri().getPath(), place.toUri().getPath())
            return True
        return not system.exists(place) and system.rename(aside, place)
    except FileExistsError:
        return False
    except Py4JJavaError as problem:
        if "FileAlreadyExistsException" in str(problem.java_exception):
            return False
        raise
    finally:
        system.delete(aside, False)
