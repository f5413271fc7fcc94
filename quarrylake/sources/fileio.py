"""Small files of tables: metadata, manifests, deletion vectors.

``LocalIO`` serves bare and ``file:`` paths; ``HadoopIO`` serves everything that Spark's file
systems reach. Both can create a file only if it is absent, which is what commits rest on.
Data files are read and written by Spark itself.
"""

from __future__ import annotations

import contextlib
import gzip
import os
import shutil
from collections import OrderedDict
from urllib.parse import unquote


class AlreadyExists(Exception):
    """The file to be created is there."""


def bare(path: str) -> str:
    """A local path without its scheme; other paths unchanged."""
    if path.startswith("file:"):
        path = unquote(path[5:])
        return "/" + path.lstrip("/")
    return path


def canonical(path: str) -> str:
    """One spelling of a path, for joins with Spark's ``_metadata.file_path``."""
    return "file://" + bare(path) if path.startswith(("/", "file:")) else path


def spark_path(c):
    """A column of Spark's file paths in the same spelling."""
    from pyspark.sql import functions as F

    plain = F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:///")


class LocalIO:
    def read(self, path: str) -> bytes:
        with open(bare(path), "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes, only_new: bool = False) -> None:
        """The whole file appears at once; ``only_new`` raises AlreadyExists if it is there."""
        path = bare(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{os.getpid()}.{os.urandom(6).hex()}.tmp"
        with open(temporary, "wb") as f:
            f.write(data)
        try:
            if only_new:
                os.link(temporary, path)  # fails if the name is taken
            else:
                os.replace(temporary, path)
        except FileExistsError as e:
            raise AlreadyExists(path) from e
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(temporary)

    def exists(self, path: str) -> bool:
        return os.path.exists(bare(path))

    def delete(self, path: str) -> None:
        """A missing file or folder is no error."""
        path = bare(path)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        else:
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)

    def list(self, path: str) -> list[str]:
        """Names in a folder; none if it is missing."""
        try:
            return sorted(os.listdir(bare(path)))
        except FileNotFoundError:
            return []

    def rename(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(bare(new)), exist_ok=True)
        os.rename(bare(old), bare(new))

    def size(self, path: str) -> int:
        return os.path.getsize(bare(path))


class HadoopIO:
    """The same by Hadoop's FileSystem, for the schemes that Spark is configured for."""

    def __init__(self, spark):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes, only_new: bool = False) -> None:
        """The whole file appears at once: it is written aside and renamed; ``only_new`` raises
        AlreadyExists if the name is taken. What a crash leaves is a file with a name of its own.

        Renaming without overwriting is one step where the file system has it (HDFS). Stores whose
        rename is a copy need a catalog service for safe commits.
        """
        fs, p = self._at(path)
        if only_new and fs.exists(p):
            raise AlreadyExists(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{os.urandom(8).hex()}.tmp")
        try:
            stream = fs.create(aside, False)
            try:
                stream.write(bytearray(data))
            finally:
                stream.close()
            how = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.gateway.new_array(how, 1)
            options[0] = how.NONE if only_new else how.OVERWRITE
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(aside, p, options)
            except Exception as e:
                if only_new and fs.exists(p):
                    raise AlreadyExists(path) from e
                raise
        finally:
            fs.delete(aside, False)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        target = self._at(new)[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"could not rename {old}")

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()


class CachingIO:
    """Remembers whole files by path, the least recently used going first; writes forget."""

    def __init__(self, inner, entries: int = 256):
        self.inner, self.entries = inner, entries
        self._held: OrderedDict[str, bytes] = OrderedDict()

    def read(self, path: str) -> bytes:
        if path in self._held:
            self._held.move_to_end(path)
            return self._held[path]
        data = self._held[path] = self.inner.read(path)
        while len(self._held) > self.entries:
            self._held.popitem(last=False)
        return data

    def write(self, path: str, data: bytes, only_new: bool = False) -> None:
        self._held.pop(path, None)
        self.inner.write(path, data, only_new)

    def delete(self, path: str) -> None:
        self._held.pop(path, None)
        self.inner.delete(path)

    def rename(self, old: str, new: str) -> None:
        self._held.pop(old, None)
        self._held.pop(new, None)
        self.inner.rename(old, new)

    def __getattr__(self, name: str):
        return getattr(self.inner, name)


def io_for(path: str, spark=None):
    """The file access that fits a path."""
    return LocalIO() if path.startswith(("/", "file:")) or spark is None else HadoopIO(spark)


def text(data: bytes) -> str:
    """Text of a file that may be gzipped."""
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8")
