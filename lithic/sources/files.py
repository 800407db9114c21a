"""Small metadata files through Hadoop's file systems, so any URI that Spark reads can hold a database."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Read, create, list and delete under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if hasattr(self._fs, "setWriteChecksum"):
            self._fs.setWriteChecksum(False)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def there(self, uri: str) -> bool:
        """Whether a whole URI of this file system exists."""
        return self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(uri))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        """Make a whole file visible at once; without ``overwrite`` an existing one is an error.

        On local disks the text goes to a file beside, which is then linked (exclusive) or moved
        (atomic) to its name; on HDFS it is renamed by one call to the name node.  Object stores
        make a file visible when its upload ends; exclusive ones are conditional uploads.
        """
        target = self._path(name)
        scheme = self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs", "webhdfs"):
            made = self._fs.createFile(target).recursive().overwrite(overwrite)
            if not overwrite:
                made = made.opt("fs.option.create.conditional.overwrite", True)
            self._fill(made.build(), text)
            return
        side = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        self._fill(self._fs.create(side, True), text)
        try:
            if scheme == "file":
                files, plain = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self._spark_strings())
                if overwrite:
                    option = self._jvm.java.nio.file.StandardCopyOption
                    options = self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.CopyOption, 2)
                    options[0], options[1] = option.ATOMIC_MOVE, option.REPLACE_EXISTING
                    files.move(plain(side), plain(target), options)
                else:
                    files.createLink(plain(target), plain(side))
            else:
                rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.OVERWRITE if overwrite else rename.NONE
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(side, target, options)
        except Exception as e:
            if not overwrite and "exist" in str(e).lower():
                raise FileExistsError(f"{name} exists") from e
            raise
        finally:
            self._fs.delete(side, False)

    def create_bytes(self, name: str, data: bytes) -> None:
        """Write a new binary file that nothing names yet."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def size_of(self, uri: str) -> int:
        return self._fs.getFileStatus(self._jvm.org.apache.hadoop.fs.Path(uri)).getLen()

    def _spark_strings(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    @staticmethod
    def _fill(stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(n for n in found if not n.endswith((".tmp", ".crc")))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"can't move {source} to {target}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
