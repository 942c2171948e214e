"""Text search by an index on disk: postings of trigrams in buckets, appended to by every run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.gates import search_terms
from tidemark.functions.text import text_of
from tidemark.streaming.state import session_with

#: Characters of a gram, and what stands between columns: no term holds it, so none matches across two.
GRAM, BETWEEN = 3, "\u0000"


def grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


@dataclass(frozen=True)
class Index:
    """Postings ``gram, id`` of rows' texts, a gram as its hash, in folders by it; ``buckets`` must stay the same.

    Two grams of one hash cost a look at a text and no result. A search reads the folders of its terms' grams alone, by partition pruning, and in them, by pushed filters, those grams.
    """

    spark: SparkSession
    path: str
    buckets: int = 32

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(gram, F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame, row_id: str, columns: Sequence[str]) -> None:
        """Post ``rows``, which must be new to the index. One job, whose files appear when it ends; a null id cannot be found.

        A task sorts what it posts by one number and writes it, a file for each bucket: nothing is shuffled, no gram gathers in a task, and files grow in number with the input, not in size.
        """
        text = F.concat_ws(BETWEEN, *(F.lower(text_of(F.col(c))) for c in columns))
        flat = rows.where(F.col(row_id).isNotNull()).select(F.explode_outer(grams(text)).alias("gram"), F.col(row_id).cast("long").alias("id")).where("gram is not null")
        flat = flat.select(F.xxhash64("gram").alias("gram"), "id").sortWithinPartitions("gram").withColumn("bucket", self._bucket(F.col("gram")))
        # all files of a task are open at once: Spark would sort by the bucket otherwise
        with session_with(self.spark, spark__sql__maxConcurrentOutputFileWriters=str(self.buckets + 1)):
            flat.write.partitionBy("bucket").parquet(f"{self.path}/run={uuid.uuid4().hex}")

    def postings(self) -> DataFrame:
        try:
            return self.spark.read.schema("gram long, id long, run string, bucket int").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "gram long, id long, run string, bucket int")

    def candidates(self, query: str, most: int = 6, least_chars: int = 2) -> DataFrame | None:
        """``id`` of the rows whose texts hold every gram of the query's terms; None where no term is long enough to have one."""
        terms = [t for t in query.lower().split() if len(t) >= least_chars][:most]
        wanted = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
        if not wanted:
            return None
        asked = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.xxhash64("gram").alias("gram"))
        found = asked.select("gram", self._bucket(F.col("gram")).alias("bucket")).distinct().collect()  # of a query's few grams
        hashes, folders = [r.gram for r in found], sorted({r.bucket for r in found})
        met = self.postings().where(F.col("bucket").isin(*folders) & F.col("gram").isin(*hashes))
        at = F.array_position(F.array(*map(F.lit, hashes)), F.col("gram")) - 1
        words = range(0, len(hashes), 62)  # a bit for each gram, so that an id combines before it is shuffled
        bit = lambda w: F.when((at >= w) & (at < w + 62), F.call_function("shiftleft", F.lit(1).cast("long"), (at - w).cast("int"))).otherwise(F.lit(0).cast("long"))
        had = met.groupBy("id").agg(*(F.bit_or(bit(w)).alias(f"_{w}") for w in words))
        return had.where(" and ".join(f"_{w} = {(1 << min(62, len(hashes) - w)) - 1}" for w in words)).select("id")

    def search(self, rows: DataFrame, row_id: str, columns: Sequence[str], query: str, most: int = 6, least_chars: int = 2) -> DataFrame:
        """The rows that ``search_terms`` finds: every term anywhere in one of the columns. Only candidates are searched."""
        found = self.candidates(query, most, least_chars)
        some = rows if found is None else rows.join(found.withColumnRenamed("id", "_id"), rows[row_id] == F.col("_id"), "left_semi")
        return search_terms(some, query, columns, most, least_chars)

