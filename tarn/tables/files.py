"""Small files of table metadata through the Hadoop file system, wherever the table lives."""

from __future__ import annotations

import os
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Schemes of object stores, whose rename is a copy.
_OBJECT_STORES = frozenset("s3 s3a gs".split())


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, name: str, absolute: bool = False) -> bytes:
        path = self.jvm.org.apache.hadoop.fs.Path(name) if absolute else self._path(name)
        fs = path.getFileSystem(self.fs.getConf()) if absolute else self.fs
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, name: str, data: bytes) -> None:
        """Write a new file under a name that nobody else uses."""
        stream = self.fs.create(self._path(name), False)
        stream.write(bytearray(data))
        stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file, over an older one if there is one; for hints only, as readers may see it half written."""
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file whole; False if it exists already. Of several writers at once exactly one succeeds.

        On a local file system a hidden file is published by a hard link, which fails where the name exists; file
        systems with an atomic rename get that, without overwriting; object stores get a conditional put.
        """
        target, scheme = self._path(name), self.fs.getUri().getScheme()
        if self.fs.exists(target):
            return False
        if scheme in _OBJECT_STORES:
            return self._put_if_absent(target, text)
        hidden = self._path(f"_{uuid4().hex}.tmp")
        stream = self.fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if scheme == "file":
                self.fs.mkdirs(target.getParent())
                os.link(hidden.toUri().getPath(), target.toUri().getPath())
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
            self.fs.mkdirs(target.getParent())
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(hidden, target, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as lost:
            if lost.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            self.fs.delete(hidden, False)

    def _put_if_absent(self, target, text: str) -> bool:
        builder = self.fs.createFile(target).overwrite(False).recursive()
        stream = builder.must("fs.option.create.conditional.overwrite", "true").build()
        stream.write(bytearray(text.encode()))
        try:
            stream.close()
        except Py4JJavaError:
            if self.fs.exists(target):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def list(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time in ms) of the files below a folder."""
        if not self.exists(folder):
            return []
        found, it = [], self.fs.listFiles(self._path(folder), True)
        while it.hasNext():
            status = it.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return sorted(found)
