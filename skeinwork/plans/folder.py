"""A folder of small files on whatever file system Spark reaches, seen from the driver."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Folder:
    """Lists, reads, makes and removes files under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, under: str) -> dict[str, int]:
        """Names directly under a folder with the milliseconds of their last change; empty without that folder."""
        path = self._path(under)
        try:
            return {f.getPath().getName(): int(f.getModificationTime()) for f in self._files.listStatus(path)}
        except Exception:
            if self._files.exists(path):
                raise
            return {}

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def text(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """Make a whole file of that name, unless there is one: of several writers exactly one gets True.

        On the local file system a link is made, elsewhere a file is renamed without overwriting; both
        happen at once or not at all.
        """
        draft = f".draft-{uuid.uuid4().hex}"
        out = self._files.create(self._path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._files.mkdirs(self._path(name).getParent())
        try:
            return self._claim(draft, name)
        finally:
            if self.exists(draft):
                self.remove(draft)

    def _claim(self, draft: str, name: str) -> bool:
        if self._files.getScheme() == "file":
            place = lambda x: unquote(urlparse(self._files.makeQualified(self._path(x)).toUri().toString()).path)
            try:
                os.link(place(draft), place(name))
            except FileExistsError:
                return False
            return True
        fs = self._jvm.org.apache.hadoop.fs
        no_overwriting = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(self._path(name).toUri(), self._conf).rename(self._path(draft), self._path(name), no_overwriting)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True
