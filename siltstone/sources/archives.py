"""Files and archive members as a data source that plans its tasks from the archives' directories.

``files.members`` opens an archive that Spark's binary source has read as one value. This source reads the
files itself, so an archive is never in memory as a whole: a large zip is dealt out by its directory, each task
opens its own members at their places, and one member at a time is in memory. A plain tar is dealt out by its
headers; a compressed one can only be read from its start and is one task, as a stream. Small files share a task.
Filters on ``path`` and ``member`` reach the plan: a member that is asked for by name is one task that reads the directory
and that member's bytes. Unlike Spark's file sources it lists empty files too.

Paths are those that pyarrow's file systems open (local, hdfs, s3, gs). Rows are those of ``files.members``, with one
exception: sizes of what lies in inner zips count for the guard on an archive's total only in the task that opens them.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..shipping import ship
from . import files

NAME = "siltstone_archive"
#: Packed bytes for each task, at about the least.
TASK_BYTES = 16 * 1024 * 1024
_PACKED_TARS = (".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
_ZSTD_TARS = (".tar.zst", ".tzst")


class _Raw(io.RawIOBase):
    """A file of pyarrow with the errors that Python's archive modules expect."""

    def __init__(self, source: pa.NativeFile):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.source.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0 if whence == io.SEEK_SET else self.source.tell() if whence == io.SEEK_CUR else self.source.size())
        if at < 0:
            raise OSError("seek before the start")
        return self.source.seek(at)

    def readinto(self, buffer) -> int:
        return self.source.readinto(buffer)

    def close(self) -> None:
        self.source.close()
        super().close()


def opened(system: fs.FileSystem, path: str) -> io.RawIOBase:
    return _Raw(system.open_input_file(path))


def _size(source: io.RawIOBase) -> int:
    at = source.tell()
    out = source.seek(0, io.SEEK_END)
    source.seek(at)
    return out


def _shown(system: fs.FileSystem, path: str) -> str:
    """The path as Spark's file sources write it."""
    return f"file:{path}" if isinstance(system, fs.LocalFileSystem) else f"{system.type_name}://{path}"


def _kind(path: str) -> str:
    low = path.lower()
    return "tar" if low.endswith(".tar") else "packed" if low.endswith(_PACKED_TARS) else "zstd" if low.endswith(_ZSTD_TARS) else "zip or file"


@dataclass
class Piece(InputPartition):
    """Whole files, or the part of one archive: members by number of a zip, by place and number of a tar."""

    paths: tuple[str, ...]
    kind: str = "whole"
    start: int = 0
    stop: int = 0
    left: int = files.MAX_TOTAL_BYTES


class Asked:
    """The names that pushed filters leave. None: every name."""

    def __init__(self):
        self.names: set[str] | None = None
        self.starts: list[str] = []

    def narrow(self, names: Iterable[str]) -> None:
        self.names = set(names) if self.names is None else self.names & set(names)

    def may_hold(self, name: str) -> bool:
        """May the name, or for a member what lies in it, be asked for?"""
        if self.names is not None and name not in self.names and not any(n.startswith(name + "!") for n in self.names):
            return False
        return all(name.startswith(s) or s.startswith(name + "!") for s in self.starts)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.path, self.member = Asked(), Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {("path",): self.path, ("member",): self.member}.get(f.attribute) if isinstance(f, EqualTo | In | StringStartsWith) else None
            if asked is not None and isinstance(f, EqualTo):
                asked.narrow([f.value])
            elif asked is not None and isinstance(f, In):
                asked.narrow(f.value)
            elif asked is not None:
                asked.starts.append(f.value)
            yield f  # Spark tests the rows as well

    def _system(self) -> tuple[fs.FileSystem, str]:
        where = self.where.replace("file:/", "file:///", 1) if self.where.startswith("file:/") and not self.where.startswith("file://") else self.where
        return fs.FileSystem.from_uri(where)

    def partitions(self) -> list[Piece]:
        """Runs on the driver: it reads names and sizes of files, and the directories of archives larger than a task."""
        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Piece] = []
        small: list[str] = []
        held = 0
        for each in sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path):
            name = posixpath.basename(each.path).lower()
            if name in files.SKIPPED_NAMES or name.startswith((".", "~$")) or not self.path.may_hold(_shown(system, each.path)):
                continue
            pieces = self._cut(system, each.path) if each.size > self.task_bytes or self.member.names is not None else None
            if pieces is not None:
                out += pieces
                continue
            small.append(each.path)
            held += each.size
            if held >= self.task_bytes:
                out.append(Piece(tuple(small)))
                small, held = [], 0
        return [*out, Piece(tuple(small))] if small or not out else out

    def _cut(self, system: fs.FileSystem, path: str) -> list[Piece] | None:
        """The pieces of an archive that can be read from more than its start; None for all other files, and for damaged ones."""
        kind = _kind(path)
        try:
            with opened(system, path) as source:
                if kind == "zip or file" and zipfile.is_zipfile(source):
                    with zipfile.ZipFile(source) as archive:
                        sizes = [(i, i + 1, info.compress_size, info.filename, 0) for i, info in enumerate(archive.infolist())]
                    kind = "zip"
                elif kind == "tar":
                    with tarfile.open(fileobj=source, mode="r:") as archive:
                        sizes = [(m.offset, 1, m.size, m.name, m.size if m.isfile() else 0) for m in archive]
                else:
                    return None
        except (OSError, zipfile.BadZipFile, tarfile.TarError, EOFError):
            return None
        # Members that nobody asks for end a piece.
        out: list[Piece] = []
        held, left, open_ = 0, files.MAX_TOTAL_BYTES, False
        for start, stop, size, name, counted in sizes:
            if not self.member.may_hold(name):
                open_ = False
            else:
                if not open_ or held >= self.task_bytes:
                    out.append(Piece((path,), kind, start, 0, left))
                    held, open_ = 0, True
                out[-1].stop = stop if kind == "zip" else out[-1].stop + 1
                held += size
            left -= counted if counted <= min(left, files.MAX_ENTRY_BYTES) else 0
        return out

    def _members(self, system: fs.FileSystem, piece: Piece) -> Iterator[tuple[str, files.Member]]:
        if piece.kind == "zip":
            with opened(system, piece.paths[0]) as source:
                wanted = lambda number, name: piece.start <= number < piece.stop and self.member.may_hold(name)
                for found in files._zip(source, "", 1, files._Budget(files.MAX_TOTAL_BYTES), wanted):
                    yield piece.paths[0], found
        elif piece.kind == "tar":
            with opened(system, piece.paths[0]) as source:
                size = _size(source)
                source.seek(piece.start)
                budget, number = files._Budget(piece.left), 0
                with tarfile.open(fileobj=source, mode="r:") as archive:
                    while number < piece.stop and (info := archive.next()) is not None:
                        number += 1
                        if info.isfile():
                            why = "path" if files.unsafe(info.name) else budget.refuses(info.size, size)
                            yield piece.paths[0], (info.name, info.size, None if why else files._read(archive.extractfile(info), info.size), why)
        else:
            for path in piece.paths:
                try:
                    for found in self._whole(system, path):
                        yield path, found
                except Exception as error:  # a damaged archive is reported, with what was read before the damage
                    yield path, (None, None, None, type(error).__name__)

    def _whole(self, system: fs.FileSystem, path: str) -> Iterator[files.Member]:
        kind, budget = _kind(path), files._Budget(files.MAX_TOTAL_BYTES)
        with opened(system, path) as source:
            if kind == "zip or file":
                if zipfile.is_zipfile(source):
                    yield from files._zip(source, "", 1, budget)
                else:
                    source.seek(0)
                    body = source.read()
                    yield posixpath.basename(path), len(body), body, None
            else:
                yield from files._tar(source, _size(source), budget, kind == "zstd")

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        try:
            for path, found in self._members(system, piece):
                yield files._row(_shown(system, path), *found)
        except Exception as error:
            yield files._row(_shown(system, piece.paths[0]), None, None, None, type(error).__name__)


class ArchiveSource(DataSource):
    """``spark.read.format(NAME).load(path)``: path, member, size, content, text, error. Option ``taskBytes``: packed bytes for each task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return files.SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, where: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per member of each archive below ``where``, one per other file. Filters on ``path`` and ``member`` decide what is opened."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("taskBytes", str(task_bytes)).load(where)


def one(spark: SparkSession, uri: str) -> DataFrame:
    """The member at ``archive://path#member``: one task, which reads the archive's directory and that member."""
    path, _, member = uri.removeprefix("archive://").partition("#")
    return read(spark, path).where(F.col("member") == member)
