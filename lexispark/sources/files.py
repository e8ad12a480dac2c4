"""Small files of a table's log through Hadoop's file systems, and creation that succeeds once."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The files under ``root``, by names relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if it is missing."""
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def age_hours(self, name: str, now_ms: float) -> float:
        return (now_ms - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 3_600_000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file unless there is one; of several writers one gets True.  Readers see all of it or nothing."""
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(self.path(draft).toUri().getPath(), self.path(name).toUri().getPath())
            else:
                options = self.spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.path(name), options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.delete(draft)
