"""Small files and folders in any file system that Spark can open, through Hadoop's interface; tables go through Spark."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else has published first."""


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, str(path).rstrip("/"), spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def of(self, name: str = "") -> str:
        return f"{self.path}/{name}" if name else self.path

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(self.of(name))

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def make(self) -> None:
        self._fs.mkdirs(self._at())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def size(self) -> int:
        return self._fs.getContentSummary(self._at()).getLength()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The file appears whole or not at all; Conflict if there is one. Hadoop's rename doesn't replace; a local one would, so there a hard link is made."""
        made = f".{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(made), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = self.jvm.java.nio.file.Paths.get
                self.jvm.java.nio.file.Files.createLink(local(self._at(name).toUri().getPath(), self._none("java.lang.String")), local(self._at(made).toUri().getPath(), self._none("java.lang.String")))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(self._fs.makeQualified(self._at(made)), self._fs.makeQualified(self._at(name)), self._none("org.apache.hadoop.fs.Options.Rename"))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.of(name)} is there already") from None
            raise
        finally:
            self.delete(made)

    def _none(self, kind: str):
        """An empty Java array, for variable arguments."""
        cls = self.jvm
        for part in kind.split("."):
            cls = getattr(cls, part)
        return self.spark.sparkContext._gateway.new_array(cls, 0)
