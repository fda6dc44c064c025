"""File operations through Hadoop's FileSystem: any store that the cluster reaches."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from tidelog.model import Status


class Env:
    def __init__(self, spark: SparkSession):
        self.spark, self._jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size_of(self, path: str) -> int:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise Status("NotFound", path)
        return fs.getFileStatus(p).getLen()

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]):
            raise Status("IOError", f"rename {old} to {new}")

    def replace(self, old: str, new: str) -> None:
        """Rename over an existing file in one step: a reader sees the old file or the new one, and a crash leaves one of them."""
        uri = self._at(new)[1].toUri()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf) if uri.getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        try:
            context.rename(self._at(old)[1], self._at(new)[1], kinds)
        except Exception as e:
            raise Status("IOError", f"rename {old} to {new}") from e

    def read_at(self, path: str, offset: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``offset`` on."""
        fs, p = self._at(path)
        left = max(0, min(size, fs.getFileStatus(p).getLen() - offset))
        stream = fs.open(p)
        try:
            stream.seek(offset)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, left)) if left else b""
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise Status("NotFound", path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode()

    def write_text(self, path: str, text: str, exclusive: bool = False) -> None:
        self.write_bytes(path, text.encode(), exclusive)

    def write_bytes(self, path: str, data: bytes, exclusive: bool = False) -> None:
        fs, p = self._at(path)
        if exclusive and fs.exists(p):
            raise Status("AlreadyExists", path)
        try:
            stream = fs.create(p, not exclusive)
        except Exception as e:
            raise Status("AlreadyExists" if exclusive else "IOError", path) from e
        stream.write(bytearray(data))
        stream.close()

    def lock(self, path: str) -> str:
        """An exclusive lock: the atomic creation of a file."""
        try:
            self.write_text(path, str(time.time()), exclusive=True)
        except Status as e:
            raise Status("LockError", f"{path} is held") from e
        return path

    def unlock(self, path: str) -> None:
        if not self.exists(path):
            raise Status("LockError", f"{path} is not held")
        self.delete(path)

    def micros(self) -> int:
        return time.time_ns() // 1000

    def sleep_for(self, micros: int) -> None:
        time.sleep(micros / 1e6)
