"""Files and archive members as rows.

``scan`` reads a folder or file through Spark's binary source; ``members`` opens zip and tar archives,
nested zips included, in ``mapInArrow`` batches. What a guard refuses becomes a row with ``error`` set and no
content, never a failure of the job. An archive's bytes are in memory while it is open, its members one after another; tars, compressed ones
too, are read as streams.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SKIPPED_NAMES = ("desktop.ini", "thumbs.db", ".ds_store")
MAX_RATIO = 150.0
MAX_ENTRY_BYTES = 50 * 1024 * 1024
MAX_TOTAL_BYTES = 2 * 1024 * 1024 * 1024
MAX_DEPTH = 2

SCHEMA = "path string, member string, size long, content binary, text string, error string"
_FIELDS = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("text", pa.string()), ("error", pa.string())])


def scan(spark: SparkSession, where: str) -> DataFrame:
    """path, size and content of every file below ``where``; hidden and junk names are left out, and so are empty files, which Spark's file sources do not list."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    junk = name.isin(*SKIPPED_NAMES) | name.startswith(".") | name.startswith("~$")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where).where(~junk).select("path", F.col("length").alias("size"), "content")


def unsafe(name: str) -> bool:
    """Does a member's path leave the archive?"""
    plain = name.replace("\\", "/")
    return not plain or plain.startswith("/") or bool(re.match("[A-Za-z]:", plain)) or ".." in plain


class _Budget:
    def __init__(self, most: int):
        self.left = most

    def refuses(self, size: int, packed: int) -> str | None:
        if size > MAX_RATIO * max(1, packed):
            return "ratio"
        if size > MAX_ENTRY_BYTES:
            return "entry size"
        if size > self.left:
            return "total size"
        self.left -= size
        return None


Member = tuple[str, int, bytes | None, str | None]


def _read(stream, size: int) -> bytes:
    """No more than the size that the guards saw, whatever the stream holds."""
    body = stream.read(size + 1)
    if len(body) > size:
        raise ValueError("longer than declared")
    return body


def _zip(source, prefix: str, depth: int, budget: _Budget, wanted=lambda number, name: True) -> Iterator[Member]:
    """Members of a zip, bytes or an open file. Those that are not wanted count for the guards but are not read."""
    with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as archive:
        for number, info in enumerate(archive.infolist()):
            name = prefix + info.filename
            if info.is_dir() or posixpath.basename(info.filename).lower() in SKIPPED_NAMES or "__macosx" in info.filename.lower():
                continue
            why = "path" if unsafe(info.filename) else budget.refuses(info.file_size, info.compress_size)
            if not wanted(number, name):
                continue
            if why:
                yield name, info.file_size, None, why
                continue
            try:
                with archive.open(info) as stream:
                    inner = _read(stream, info.file_size)
                if info.filename.lower().endswith(".zip") and depth < MAX_DEPTH:
                    yield from _zip(inner, name + "!", depth + 1, budget)
                else:
                    yield name, info.file_size, inner, None
            except Exception as error:  # a damaged member is reported; the others are still read
                yield name, info.file_size, None, type(error).__name__


def _tar(source, size: int, budget: _Budget, packed_by_zstd: bool = False) -> Iterator[Member]:
    """Members of a tar of so many bytes, read as a stream."""
    if packed_by_zstd:
        import zstandard

        source = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
    with tarfile.open(fileobj=source, mode="r|" if packed_by_zstd else "r|*") as archive:
        for info in archive:
            if not info.isfile():
                continue
            # A compressed tar has no packed size for each member; the whole archive's stands in.
            why = "path" if unsafe(info.name) else budget.refuses(info.size, size)
            yield info.name, info.size, None if why else _read(archive.extractfile(info), info.size), why


def open_archive(path: str, body: bytes) -> Iterator[Member]:
    low, budget = path.lower(), _Budget(MAX_TOTAL_BYTES)
    if low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        yield from _tar(io.BytesIO(body), len(body), budget)
    elif low.endswith((".tar.zst", ".tzst")):
        yield from _tar(io.BytesIO(body), len(body), budget, packed_by_zstd=True)
    elif zipfile.is_zipfile(io.BytesIO(body)):
        yield from _zip(body, "", 1, budget)
    else:
        yield posixpath.basename(path), len(body), body, None


def decoded(body: bytes) -> str | None:
    """Text of bytes: UTF-8 with or without a mark, UTF-16 with one, Windows-1252, else Latin-1; None where a zero byte shows binary data."""
    charsets = ("utf-16",) if body[:2] in (b"\xff\xfe", b"\xfe\xff") else () if b"\0" in body else ("utf-8-sig", "cp1252", "latin-1")
    for charset in charsets:
        try:
            return body.decode(charset)
        except UnicodeDecodeError:
            continue
    return None


def _row(path: str, member: str | None, size: int | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
    text = None if content is None else decoded(content)
    return pa.RecordBatch.from_pylist([{"path": path, "member": member, "size": size, "content": content, "text": text, "error": error}], schema=_FIELDS)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                for found in open_archive(path, body.as_py() or b""):
                    yield _row(path, *found)
            except Exception as error:  # a damaged archive is reported, with what was read before the damage
                yield _row(path, None, None, None, type(error).__name__)


def resolve(uris: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, path, member, size, content, text, error) of single members, for uris (uri) as ``archive://path#member`` and files (path, content).

    Only the archives that are asked for are opened. An address that is none, or names nothing, gives a row with an error.
    """
    from ..functions import text as T

    asked = uris.select("uri", T.parse_virtual_uri(F.col("uri")).alias("at")).select("uri", F.col("at.archive").alias("archive"), F.col("at.entry").alias("entry"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    held = files.withColumn("archive", plain).join(asked.select("archive").distinct(), "archive", "left_semi")
    found = members(held).withColumn("archive", plain).withColumnRenamed("member", "entry")
    out = asked.join(found, ["archive", "entry"], "left")
    missing = F.when(F.col("archive").isNull(), "no address").when(F.col("path").isNull(), "not found")
    return out.select("uri", "path", F.col("entry").alias("member"), "size", "content", "text", F.coalesce("error", missing).alias("error"))


def directory_stats(files: DataFrame, sentinel: str = ".no-index") -> DataFrame:
    """(directory, files, bytes, formats) of binary files (path, size), without folders that hold the sentinel file and what lies below them; formats maps endings to counts."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    placed = files.select("path", "size", folder.alias("directory"))
    barred = placed.where(F.col("path").endswith("/" + sentinel)).select(F.col("directory").alias("barred")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("directory", "/"))), lambda n: F.array_join(F.slice(F.split("directory", "/"), F.lit(1), n), "/"))
    hidden = placed.select("directory").distinct().withColumn("barred", F.explode(above)).join(barred, "barred", "left_semi").select("directory").distinct()
    ending = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    rows = placed.join(hidden, "directory", "left_anti").groupBy("directory", ending.alias("ending")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return rows.groupBy("directory").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ending", "n")))).alias("formats"))


def members(files: DataFrame) -> DataFrame:
    """path, member, size, content, its text and error: one row per member of each archive, one per other file."""
    return files.select("path", "content").mapInArrow(_open, SCHEMA)
