"""Small control files in a folder that all writers share: made whole or not at all, never overwritten."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of JSON files, reached through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.at(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder)))

    def load(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> bool:
        """Write a file; False if it is there already.

        The content goes to a file of another name first and is then renamed without overwriting, so that
        a writer that dies in between leaves nothing that readers see. On a local disk a hard link does that.
        """
        draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.at(draft), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                where = lambda n: self.fs.makeQualified(self.at(n)).toUri().getPath()
                try:
                    os.link(where(draft), where(name))
                except FileExistsError:
                    return False
                return True
            if self.exists(name):
                return False
            try:
                files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
                never = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                files.rename(self.at(draft), self.at(name), never)
            except Exception:
                if self.exists(name):  # another writer was first
                    return False
                raise
            return True
        finally:
            if self.exists(draft):
                self.delete(draft)
