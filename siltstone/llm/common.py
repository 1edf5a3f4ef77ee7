"""Helpers that the corpus operators share: table access, native text splitting, durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that their Python workers can import it."""
    context, top = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if any(name.startswith("siltstone_llm_") for name in context._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="siltstone-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/siltstone_llm_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(f"{where}/{name}", f"siltstone/{os.path.relpath(f'{where}/{name}', top)}")
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on a local master may spark.checkpoint.dir be unset: a temporary folder then serves; on a cluster each host would have its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Store:
    """Intermediate tables, written as Parquet in the shared folder and read back.

    Writing cuts lineage, and unlike a cached block the files outlive a lost executor. ``drop`` removes
    a table as soon as a later one replaces it, so that iterations keep a bounded amount of disk; the shuffle
    files of a write go as soon as it is done.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    #: All stores of this process that were not dropped as a whole, in the order in which they were made.
    made: list["Store"] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        Store.made.append(self)

    def put(self, name: str, df: DataFrame, group_rows: int | None = None) -> DataFrame:
        """Writes and reads back a table. Rows of megabytes need ``group_rows``, the rows of a row group: Parquet looks at the size of a page or group
        after a hundred rows only, and is read by up to 4096 rows at once, but never beyond a group."""
        path = f"{self.root}/{name}"
        groups = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").options(**groups).parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more. Names that are not there are no error."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all of the store's tables."""
        self._delete(self.root)
        Store.made.remove(self)


def row_struct(df: DataFrame) -> Column:
    """All columns of a row in one struct; ``select("struct.*")`` gives them back."""
    return F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in df.columns))


def words(text: Column) -> Column:
    """The words of a text; of a null text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one ASCII character. ``replace`` works on bytes, far faster than a regular expression."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def count_chars(text: Column, chars: tuple[str, ...]) -> Column:
    total = count_char(text, chars[0])
    for char in chars[1:]:
        total = total + count_char(text, char)
    return total.cast("long")


def md5_long(value: Column) -> Column:
    """The first 52 bits of the MD5 of a string, as a long; the same in every SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


def md5_unit(value: Column) -> Column:
    """A number strictly between 0 and 1 drawn from a string."""
    return (md5_long(value) + F.lit(0.5)) / F.lit(float(1 << 52))
