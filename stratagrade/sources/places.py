"""Files and folders on any file system that the session reaches.

A Place is a path of the driver's own disk or a URI (hdfs://, s3a://, viewfs://, ...).
Local ones need no session; all others go through Hadoop's file systems, as Spark's
own readers and writers do.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import closing
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(?=/|$)")
_PART = 1 << 20


class _Stored(io.RawIOBase):
    """A file of a Hadoop file system for reading, from any position."""

    def __init__(self, place: Place):
        fs, path, self._jvm = place._hadoop()
        self._stream, self._size, self._at = fs.open(path), fs.getFileStatus(path).getLen(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence])
        return self._at

    def readinto(self, into) -> int:
        n = min(len(into), self._size - self._at)
        if n <= 0:
            return 0
        self._stream.seek(self._at)
        into[:n] = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n))
        self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


class _Storing(io.RawIOBase):
    """A new file of a Hadoop file system, written from its start."""

    def __init__(self, place: Place):
        fs, path, _ = place._hadoop()
        self._stream = fs.create(path, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


class Place:
    """Where a file or folder is, be it there or not."""

    def __init__(self, path):
        text = str(path)
        found = _SCHEME.match(text)
        local = not found or found[1] == "file"
        self.root = "" if local else f"{found[1]}://{found[2] or ''}"
        rest = text[found.end() :] if found else text
        if found and local:
            rest = unquote(rest)
        self.path = PurePosixPath(Path(rest).expanduser().resolve() if local else os.path.normpath("/" + rest.lstrip("/")))

    @property
    def local(self) -> Path | None:
        return None if self.root else Path(self.path)

    @property
    def uri(self) -> str:
        """For Spark and Hadoop, which take paths as they are written."""
        return (self.root or "file://") + str(self.path)

    name = property(lambda self: self.path.name)
    stem = property(lambda self: self.path.stem)
    suffix = property(lambda self: self.path.suffix)
    parent = property(lambda self: Place(self.root + str(self.path.parent)))

    def __str__(self) -> str:
        return self.root + str(self.path)

    __repr__ = __str__

    def __truediv__(self, more) -> Place:
        return Place(self.root + str(self.path / str(more)))

    def __eq__(self, other) -> bool:
        return isinstance(other, Place) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def below(self, root: Place) -> str | None:
        """The path from `root`, if this is below it."""
        inside = self.root == root.root and self.path.is_relative_to(root.path)
        return self.path.relative_to(root.path).as_posix() if inside else None

    # Hadoop -----------------------------------------------------------------------

    def _hadoop(self):
        """The file system, the path there, and the JVM."""
        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path(str(self))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path, spark._jvm

    def _status(self):
        fs, path, _ = self._hadoop()
        return fs.getFileStatus(path) if fs.exists(path) else None

    def exists(self) -> bool:
        return self.local.exists() if self.local else self._status() is not None

    def is_file(self) -> bool:
        if self.local:
            return self.local.is_file()
        found = self._status()
        return found is not None and found.isFile()

    def is_dir(self) -> bool:
        if self.local:
            return self.local.is_dir()
        found = self._status()
        return found is not None and found.isDirectory()

    def files(self) -> list[Place]:
        """The files of a folder, by name; none if it isn't there."""
        if not self.is_dir():
            return []
        if self.local:
            return sorted((Place(p) for p in self.local.iterdir() if p.is_file()), key=lambda p: p.name)
        fs, path, _ = self._hadoop()
        return sorted((self / s.getPath().getName() for s in fs.listStatus(path) if s.isFile()), key=lambda p: p.name)

    def read_bytes(self) -> bytes:
        if self.local:
            return self.local.read_bytes()
        fs, path, jvm = self._hadoop()
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_head(self, n: int) -> bytes:
        """The first n bytes, or all if there are fewer."""
        if self.local:
            with self.local.open("rb") as f:
                return f.read(n)
        fs, path, jvm = self._hadoop()
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, fs.getFileStatus(path).getLen())))
        finally:
            stream.close()

    def reader(self) -> io.BufferedIOBase:
        """The file's bytes from any position."""
        return self.local.open("rb") if self.local else io.BufferedReader(_Stored(self), _PART)

    def writer(self) -> io.BufferedIOBase:
        """A new file to be written piece by piece; folders above are made."""
        if self.local:
            self.local.parent.mkdir(parents=True, exist_ok=True)
            return self.local.open("wb")
        return io.BufferedWriter(_Storing(self), _PART)

    def size(self) -> int:
        return self.local.stat().st_size if self.local else self._status().getLen()

    def write_joined(self, head: str, parts: list[Place], tail: str, less: int = 0) -> None:
        """`head`, the bytes of the parts but the last `less` ones, and `tail`; bytes between
        places that are not local stay in the JVM."""
        sizes = [p.size() for p in parts]
        sizes[-1] -= less
        if self.local:
            with closing(self.writer()) as out:
                out.write(head.encode())
                for part, left in zip(parts, sizes, strict=True):
                    with closing(part.reader()) as source:
                        while left and (data := source.read(min(left, _PART))):
                            out.write(data)
                            left -= len(data)
                out.write(tail.encode())
            return
        fs, path, jvm = self._hadoop()
        out = fs.create(path, True)
        try:
            out.write(bytearray(head.encode()))
            for part, size in zip(parts, sizes, strict=True):
                there, at = jvm.org.apache.hadoop.fs.Path(part.uri), SparkSession.active()._jsc.hadoopConfiguration()
                source = there.getFileSystem(at).open(there)
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
                finally:
                    source.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()

    def copy_to(self, target: Place) -> None:
        """The same bytes at another place, a part at a time."""
        with closing(self.reader()) as source, closing(target.writer()) as copy:
            while part := source.read(_PART):
                copy.write(part)

    def read_text(self) -> str:
        """As UTF-8, without a byte order mark."""
        return self.read_bytes().decode("utf-8-sig")

    def write(self, chunks: Iterable[str]) -> None:
        """The texts one after another, as UTF-8; folders above are made."""
        if self.local:
            self.local.parent.mkdir(parents=True, exist_ok=True)
            with self.local.open("w", encoding="utf-8", newline="\n") as f:
                f.writelines(chunks)
            return
        fs, path, _ = self._hadoop()
        stream = fs.create(path, True)
        try:
            held, size = [], 0
            for chunk in chunks:
                held.append(chunk)
                size += len(chunk)
                if size > _PART:
                    stream.write(bytearray("".join(held).encode()))
                    held, size = [], 0
            stream.write(bytearray("".join(held).encode()))
        finally:
            stream.close()

    def write_bytes(self, data: bytes) -> None:
        if self.local:
            self.local.parent.mkdir(parents=True, exist_ok=True)
            self.local.write_bytes(data)
            return
        fs, path, _ = self._hadoop()
        stream = fs.create(path, True)
        try:
            for at in range(0, len(data), _PART):
                stream.write(bytearray(data[at : at + _PART]))
        finally:
            stream.close()

    def beside(self) -> Place:
        """A name of its own in the same folder, hidden from readers."""
        return self.parent / f".{self.name}.{uuid.uuid4().hex}.tmp"

    def replace(self, target: Place) -> None:
        """Put this file in the place of `target`, which may be there."""
        if self.local:
            os.replace(self.local, target.local)
            return
        spark = SparkSession.active()
        fs = spark._jvm.org.apache.hadoop.fs
        modes = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        modes[0] = fs.Options.Rename.OVERWRITE
        source, there = fs.Path(str(self)), fs.Path(str(target))
        fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, there, modes)

    def delete(self) -> None:
        """Remove the file or the folder with all it holds, if it is there."""
        fs, path, _ = self._hadoop() if not self.local else (None, None, None)
        if fs is not None:
            fs.delete(path, True)
        elif self.local.is_dir():
            import shutil

            shutil.rmtree(self.local)
        else:
            self.local.unlink(missing_ok=True)


def scratch_folder(tag: str) -> Place:
    """A new folder that executors see: below spark.checkpoint.dir, or on one machine, where
    that is unset, below the folder for temporary files."""
    spark = SparkSession.active()
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.gettempdir()
    return Place(shared) / f"spark-stratagrade-{tag}-{uuid.uuid4().hex}"
