"""Keep-first, per-group and two-level top-k, orders and batches. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import text_of
from tidemark.tables import materialise


def keep_first(df: DataFrame, key: Column | str, order: Sequence[Column | str], blank: str = "drop") -> DataFrame:
    """The first row of each key; rows with a blank key go (``drop``) or all stay (``keep``)."""
    k = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_key", k)
    some = keyed.where(F.trim(text_of(F.col("_key"))) != "")
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n")
    if blank == "keep":
        first = first.unionByName(keyed.where(F.trim(text_of(F.col("_key"))) == ""))
    return first.drop("_key")


def top_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column | str], most: int, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= most)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "place") -> DataFrame:
    """The rows with their place in one global order, from 1: sorted by range, numbered inside each range, plus the rows of the ranges before."""
    ranges = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ranges.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select("_r", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = ranges.join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn(out, inside + F.col("_start")).drop("_range", "_r", "_start")


def ranked(df: DataFrame, order: Sequence[Column | str], out: str = "place", most: int | None = None) -> DataFrame:
    """The rows with their place in one order. With ``most`` only so many are kept first and numbered."""
    if not most:
        return numbered(df, order, out)
    return df.orderBy(*order).limit(most).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def report_rank(df: DataFrame, new: Column, action: Column, score: Column, key: str, top: int, out: str = "place") -> DataFrame:
    """Report order: new persons first, then by action (investigate, watchlist, the rest), then best score; ``top`` marks the first so many."""
    rank = F.when(action == "investigate", 0).when(action == "watchlist", 1).otherwise(2)
    keyed = df.withColumns({"_old": ~new, "_rank": rank, "_best": -score})
    return numbered(keyed, ["_old", "_rank", "_best", key], out).withColumn("top", F.col(out) <= top).drop("_old", "_rank", "_best")


def recent_groups(df: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """The rows of the ``most`` labels with the largest keys."""
    labels = df.select(label, key.alias("_key")).distinct().orderBy(F.desc("_key"), label).limit(most).select(label)
    return df.join(labels, label, "left_semi")


def round_robin(df: DataFrame, order: Sequence[str], buckets: int, day: int) -> DataFrame:
    """The rows whose turn it is on a day: place modulo buckets equals day modulo buckets."""
    placed = numbered(df, order).withColumn("place", F.col("place") - 1)
    return placed.where(F.col("place") % buckets == day % buckets)


def batches(df: DataFrame, order: Sequence[str], value: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Values in lists of ``size``, in order, per group where ``by`` is given."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else numbered(df, order, "_place")
    placed = placed.withColumn("_place", F.col("_place") - 1).withColumn("batch", F.floor(F.col("_place") / size))
    listed = F.array_sort(F.collect_list(F.struct("_place", value)))
    return placed.groupBy(*by, "batch").agg(F.array_join(F.transform(listed, lambda x: x[value].cast("string")), " OR ").alias("items"))
