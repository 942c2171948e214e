"""Indexed search against the scan; sketches against exact counts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tidemark.functions.gates import search_terms
from tidemark.operators import sketches
from tidemark.operators.search import Index
from tidemark.tables import materialise


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, *("".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) for _ in range(2))) for i in range(300)] + [(300, None, "ABBA é"), (301, "", None)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    index = Index(spark, str(tmp_path / "i"), buckets=4)
    assert index.search(df, "id", ["a", "b"], "abb").count() == 0
    index.add(df.where("id < 150"), "id", ["a", "b"])
    index.add(df.where("id >= 150"), "id", ["a", "b"])
    for query in ("abb", "ABBA", "ab é", "a", "", "zzz abb", "bab abé", "aaa bbb"):
        got = sorted(r.id for r in index.search(df, "id", ["a", "b"], query).collect())
        assert got == sorted(r.id for r in search_terms(df, query, ["a", "b"]).collect()), query
    plan = index.candidates("abbab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_posting_shuffles_nothing_and_sorts_by_a_number(spark, tmp_path, monkeypatch):
    """A shuffle into a fixed number of parts, and comparisons of rows of which most share a bucket, were most of the work."""
    plans, written = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return written(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    index, rows = Index(spark, str(tmp_path / "i"), buckets=3), spark.range(400).selectExpr("id", "concat(id, ' abc ', id * 7919) as a").repartition(5)
    index.add(materialise(rows), "id", ["a"])
    assert "Repartition" not in plans[-1] and re.findall(r"Sort \[(\w+)", plans[-1]) == ["gram"]
    files = index.postings().select(F.input_file_name().alias("f"), "gram").collect()
    assert all(files[i].gram <= files[i + 1].gram for i in range(len(files) - 1) if files[i].f == files[i + 1].f)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_search_of_many_grams(spark, tmp_path):
    """More grams than a number has bits; a row that lacks the last only."""
    long = "".join(chr(0x4E00 + i) for i in range(150))
    df = spark.createDataFrame([(1, long), (2, long[:-1]), (3, long[1:]), (4, "x" + long + "y"), (None, long)], "id long, a string")
    index = Index(spark, str(tmp_path / "i"))
    index.add(df, "id", ["a"])
    for query, want in ((long, [1, 4]), (f"{long[:70]} {long[70:140]}", [1, 2, 4]), (long[:64], [1, 2, 4]), (long[:65], [1, 2, 4])):
        assert sorted(r.id for r in index.candidates(query).collect()) == want
        assert sorted(r.id for r in index.search(df, "id", ["a"], query).collect()) == want


@pytest.mark.parametrize(("lg", "items", "error"), [(14, 500, 0.0), (14, 60_000, 0.03), (10, 60_000, 0.1)])
def test_windows_merge_from_days(spark, lg, items, error):
    rows = spark.range(items * 3).selectExpr(f"date_sub(date'2024-01-31', cast(id % 40 as int)) as day", f"id * 7919 % {items} as item")
    got = {r.days: (r.n, r.n_distinct) for r in sketches.windows(sketches.day_sketches(rows, F.col("day"), F.col("item"), lg=lg), "2024-01-31", (1, 7, 30)).collect()}
    for days, (n, estimate) in got.items():
        exact = rows.where(f"day > date_sub(date'2024-01-31', {days})").agg(F.count("item"), F.count_distinct("item")).first()
        assert n == exact[0] and abs(estimate - exact[1]) <= error * exact[1]
    assert set(got) == {1, 7, 30}


def test_exact_windows_count_every_item(spark):
    """A sketch is off by hundreds here."""
    rows = spark.range(400_000).selectExpr("date_sub(date'2024-02-02', cast(id % 45 as int)) as day", "if(id % 11 = 0, null, id * 7919 % 150000) as item", "id % 2 as kind")
    got = {(r.days, r.kind): (r.n, r.n_distinct) for r in sketches.exact_windows(sketches.day_items(rows, F.col("day"), F.col("item"), ["kind"]), "2024-01-31", (1, 7, 30), ["kind"]).collect()}
    for days in (1, 7, 30):
        some = rows.where(f"day <= date'2024-01-31' and day > date_sub(date'2024-01-31', {days})")
        for r in some.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("m")).collect():
            assert got.pop((days, r.kind)) == (r.n, r.m)
    assert not got
