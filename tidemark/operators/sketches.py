"""Counts of distinct and of frequent items that any window of days merges from day rows: estimated from sketches, or exact from each day's items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def day_sketches(rows: DataFrame, day: Column, item: Column, by: Sequence[str] = (), lg: int = 14) -> DataFrame:
    """``day``, ``by``, ``n`` and ``distinct``, a HyperLogLog sketch of the items (not null) of each day: some kilobytes a day, whatever the rows.

    Up to about 2 ** (lg - 4) items a sketch keeps the items' hashes and the estimate is as good as exact; beyond, its relative error is about 0.8 / 2 ** (lg / 2).
    """
    return rows.groupBy(day.alias("day"), *by).agg(F.count(item).alias("n"), F.hll_sketch_agg(item, lg).alias("distinct"))


def windows(sketches: DataFrame, as_of: str, days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``days``, ``by``, ``n`` and ``n_distinct`` (estimated) of the windows of so many days that end on the date ``as_of``, from day rows alone."""
    ended = F.lit(as_of).cast("date")
    sizes = F.filter(F.array(*map(F.lit, days)), lambda d: F.col("day") > F.date_sub(ended, d))
    each = sketches.where(F.col("day") <= ended).withColumn("days", F.explode(sizes))
    return each.groupBy("days", *by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"))


def day_items(rows: DataFrame, day: Column, item: Column, by: Sequence[str] = ()) -> DataFrame:
    """``day``, ``by``, ``item`` and ``n``: each item of each day once with its number, a null one too. Exact, and as large as a day has distinct items."""
    return rows.groupBy(day.alias("day"), *by, item.alias("item")).agg(F.count(F.lit(1)).alias("n"))


def exact_windows(items: DataFrame, as_of: str, days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``days``, ``by``, ``n`` (rows) and ``n_distinct`` (items not null), exact, from rows of ``day_items`` alone.

    An item's last day says in which windows it is: per item one row shuffles, with its count in each window, whatever the days.
    """
    ended = F.lit(as_of).cast("date")
    within = lambda d: F.col("day") > F.date_sub(ended, d)
    some = items.where((F.col("day") <= ended) & within(max(days)))
    each = some.groupBy(*by, "item").agg(*(F.sum(F.when(within(d), F.col("n"))).alias(f"_{d}") for d in days))
    windows = each.select(*by, "item", F.inline(F.array(*(F.struct(F.lit(d).alias("days"), F.col(f"_{d}").alias("n")) for d in days)))).where("n is not null")
    return windows.groupBy("days", *by).agg(F.sum("n").alias("n"), F.count("item").alias("n_distinct"))


def day_tops(rows: DataFrame, day: Column, item: Column, tracked: int = 1000) -> DataFrame:
    """``day, top``: a sketch of each day's frequent items."""
    return rows.withColumn("_item", item).groupBy(day.alias("day")).agg(F.expr(f"approx_top_k_accumulate(_item, {tracked})").alias("top"))


def top_of(tops: DataFrame, as_of: str, days: int, k: int, tracked: int = 1000) -> DataFrame:
    """``item, n`` of the ``k`` most frequent items of a window, from day rows alone: exact while no more than ``tracked`` differ, else no count is too low by more than the sketch's error."""
    ended = F.lit(as_of).cast("date")
    some = tops.where((F.col("day") <= ended) & (F.col("day") > F.date_sub(ended, days)))
    best = some.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {tracked}), {k})").alias("best"))
    return best.select(F.inline("best")).select("item", F.col("count").alias("n"))
