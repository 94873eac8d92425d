"""The folder that driver and executors share, and files in any store that Hadoop knows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def configured(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session, if set."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a session on one machine, as in tests, gets one of its own; a cluster must name it."""
    found = configured(spark)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, as a path of the file system that all machines mount. Other stores cannot hold a source tree."""
    base = shared_base(spark)
    if "://" in base and not base.startswith("file://"):
        raise ValueError(f"{base} is no mounted folder: source trees and request files need one")
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"brindle-{purpose}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch():
    """Tables that ``settled`` writes inside are deleted at the end: for work whose result is written elsewhere, or small."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(path)


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def settled(table: DataFrame) -> DataFrame:
    """``table``, computed once: written to the shared folder and read again, which cuts its lineage, so that a lost executor costs the tasks it was running. A
    cluster must name that folder."""
    path = f"{shared_base(table.sparkSession)}/brindle-{uuid.uuid4().hex}"
    table.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class Store:
    """Small files beside Spark's own, through the same Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder
        # found once: each name of a package is a question to the JVM
        self.made = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.made(f"{self.folder}/{name}" if name else self.folder)

    def is_file(self, name: str) -> bool:
        return self.fs.exists(self.path(name)) and self.fs.getFileStatus(self.path(name)).isFile()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed over what was there."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._rename(self.path(beside), self.path(name))

    @cached_property
    def _over(self):
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        return self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf), over

    def _rename(self, old, new) -> None:
        context, over = self._over
        context.rename(old, new, over)

    def files(self, name: str) -> list[str]:
        """Names of the files in a folder that readers of tables would see, in order."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(name)) if s.isFile()]
        return sorted(f for f in found if not f.startswith(("_", ".")))

    def move(self, name: str, to: str, new: bool = False) -> None:
        """``new``: nothing is named ``to`` yet. Then a plain rename will do, which takes a tenth of the time on a local store."""
        if not (new and self.fs.rename(self.path(name), self.path(to))):
            self._rename(self.path(name), self.path(to))

    def folders(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path("")) if s.isDirectory()] if self.fs.exists(self.path("")) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def delete_if_empty(self) -> None:
        if self.fs.exists(self.path("")) and not len(self.fs.listStatus(self.path(""))):
            self.fs.delete(self.path(""), False)
