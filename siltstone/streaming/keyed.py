"""A table of rows by key that a stream changes batch by batch: a base and the changes since, in buckets of keys.

A batch writes one folder with its rows and the keys that it takes out, under its number; done again, it replaces that
folder. What a key has is what the last batch said of it. From time to time all batches but the last are merged into a new
base, which counts once it is whole, and only then what it replaces goes; the last batch stays apart, so that it can be
done again over the state before it. A lookup of some keys reads their buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MERGE_AFTER = 64, 32


class KeyedTable:
    """Rows of ``schema``, one for each value of the column ``key``; buckets and lookups go by the column ``by``, which is the key if none is given."""

    def __init__(self, spark: SparkSession, where: str, schema: str, key: str, by: str | None = None, buckets: int = BUCKETS, merge_after: int = MERGE_AFTER):
        self.spark, self.where, self.schema, self.key, self.by = spark, where.rstrip("/"), schema, key, by or key
        self.buckets, self.merge_after = buckets, merge_after
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.where}/{name}" if name else self.where)

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def numbers(self, kind: str) -> list[int]:
        """Numbers of whole folders of a kind, ``base`` or ``batch``."""
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{kind}-") and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int"))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, __gone boolean, __bucket int").parquet(f"{self.where}/{name}")

    def _latest(self, before: int | None, only: DataFrame | None) -> DataFrame:
        bases = [n for n in self.numbers("base") if before is None or n < before]
        from_ = bases[-1] if bases else -1
        names = [(f"base-{n}", n) for n in bases[-1:]] + [(f"batch-{n}", n) for n in self.numbers("batch") if n > from_ and (before is None or n < before)]
        rows = self._dealt(self.nothing()).withColumn("__gone", F.lit(False)).withColumn("__number", F.lit(0).cast("long"))
        for name, n in names:
            rows = rows.unionByName(self._read(name).withColumn("__number", F.lit(n).cast("long")))
        if only is not None:
            rows = rows.join(self._dealt(only.select(F.col(only.columns[0]).alias(self.by)).distinct()), ["__bucket", self.by], "left_semi")
        columns = [c for c in self.nothing().columns if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns, "__gone"), "__number").alias("__last"))
        return last.where("not __last.__gone").select(*(F.col(c) if c == self.key else F.col(f"__last.{c}").alias(c) for c in self.nothing().columns))

    def current(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows after all batches, or after those before a number; with ``only``, those whose ``by`` is in its first column."""
        return self._latest(before, only)

    def put(self, number: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """What batch ``number`` changes: rows to be there, and keys (first column) that go unless a row has them. Of rows that share a key, one counts."""
        columns = self.nothing().columns
        new = rows.select(*columns).dropDuplicates([self.key]).withColumn("__gone", F.lit(False))
        if gone is not None:
            keys = gone.select(F.col(gone.columns[0]).alias(self.key)).distinct().join(new.select(self.key), self.key, "left_anti")
            empty = self.nothing()
            new = new.unionByName(keys.select(*(F.col(c) if c == self.key else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in columns), F.lit(True).alias("__gone")))
        self._dealt(new).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.where}/batch-{number}")
        if len([n for n in self.numbers("batch") if n < number]) >= self.merge_after:
            self.merge(number)

    def merge(self, number: int) -> None:
        """A base of all batches before ``number``; what it replaces goes when it is whole."""
        olds = [n for n in self.numbers("batch") if n < number]
        if not olds:
            return
        last = olds[-1]
        rows = self._latest(number, None).withColumn("__gone", F.lit(False))
        self._dealt(rows).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.where}/base-{last}")
        for name in [f"batch-{n}" for n in olds] + [f"base-{n}" for n in self.numbers("base") if n < last]:
            self._fs.delete(self._path(name), True)
