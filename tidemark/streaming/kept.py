"""State that is kept between runs: a snapshot in hash buckets, of which a run rewrites those it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.tables import materialise

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Kept:
    """A table of ``schema`` under ``path``, one row or more for each ``key``, in ``buckets`` by a hash of the key.

    A run writes its buckets to a folder of its own and then one file of the manifest, which names the folder of each bucket it wrote. A reader takes each
    bucket from the last run that names it, so a run that fails before its manifest leaves the table as it was, and what it wrote is read by nobody.
    One run at a time may merge. ``buckets`` must stay the same; old folders are for the owner to clear.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def manifest(self) -> dict[int, tuple[int, str]]:
        """Of every bucket that a run wrote the last run's number and folder (blank: the bucket is empty)."""
        try:
            runs = self.spark.read.schema("run long, bucket int, folder string").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        last = runs.groupBy("bucket").agg(F.max(F.struct("run", "folder")).alias("last"))
        return {r.bucket: (r.last.run, r.last.folder) for r in last.collect()}

    def _read(self, folders: Iterable[tuple[int, str]]) -> DataFrame:
        paths = [f"{folder}/_bucket={bucket}" for bucket, folder in folders if folder]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read((bucket, folder) for bucket, (_, folder) in self.manifest().items())

    def merge(self, news: DataFrame, how: Merge) -> int:
        """Put ``how(old, news)`` in place of the rows of all buckets that keys of ``news`` fall in; returns how many those are.

        ``how`` sees the old rows of these buckets alone, and what it returns must keep to their keys.
        """
        news = materialise(self._bucket(news))
        touched = sorted(r._bucket for r in news.select("_bucket").distinct().collect())
        held = self.manifest()
        old = self._read((b, held[b][1]) for b in touched if b in held)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merged = self._bucket(how(old, news.drop("_bucket")).select(*self.schema.names)).repartition("_bucket")
        merged.write.partitionBy("_bucket").parquet(folder)
        there = {r._bucket for r in self.spark.read.parquet(folder).select("_bucket").distinct().collect()} if not merged.isEmpty() else set()
        if there - set(touched):
            raise ValueError("the merge made rows of keys that no new row has")
        run = 1 + max((n for n, _ in held.values()), default=0)
        rows = [(run, b, folder if b in there else "") for b in touched]
        if rows:
            self.spark.createDataFrame(rows, "run long, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return len(touched)
