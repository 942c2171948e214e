"""State over several runs: kept tables, streams on one checkpoint, sources that fail."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Row, functions as F

from tidemark.sources import isolated
from tidemark.streaming import state
from tidemark.streaming.kept import Kept


def summed(old, news):
    return old.unionByName(news).groupBy("k").agg(F.sum("n").alias("n"))


def test_a_run_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = Kept(spark, str(tmp_path / "t"), "k", spark.createDataFrame([], "k string, n long").schema, buckets=8)
    assert table.read().count() == 0
    all_rows = spark.createDataFrame([(f"k{i}", 1) for i in range(50)] + [(None, 1)], "k string, n long")
    assert table.merge(all_rows, summed) == 8
    before = table.manifest()
    assert table.merge(all_rows.where("k = 'k7'"), summed) == 1
    after = table.manifest()
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.k: r.n for r in table.read().collect()} == {f"k{i}": 1 + (i == 7) for i in range(50)} | {None: 1}
    with pytest.raises(Exception, match="lost"):
        table.merge(all_rows, lambda old, news: news.withColumn("n", F.raise_error(F.lit("lost")).cast("long")))
    assert table.manifest() == after
    with pytest.raises(ValueError, match="no new row"):
        table.merge(all_rows.where("k = 'k7'"), lambda old, news: all_rows)
    assert table.merge(all_rows, lambda old, news: old.where("false")) == 8 and table.read().count() == 0
    assert table.merge(all_rows.where("false"), summed) == 0


def test_forgotten_profiles_come_back_as_new(spark, tmp_path):
    with state.rocksdb(spark):
        for day, wait in enumerate((0, 6)):
            time.sleep(wait)
            spark.createDataFrame([("p", day, "same", "Ann")], "p string, o int, h string, n string").write.mode("append").parquet(f"{tmp_path}/in")
            rows = spark.readStream.schema("p string, o int, h string, n string").parquet(f"{tmp_path}/in")
            state.run_available(state.watch_profiles(rows, "p", "o", "h", ttl_ms=3000, name="n"), f"{tmp_path}/out", f"{tmp_path}/marks", by_clock=True)
    assert {r.ord: r.delta for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {0: "new", 1: "new"}


def test_a_profile_costs_one_look_and_one_write_of_state(spark):
    """Each call of the state is a message to the JVM."""
    calls, values = [], {}

    class Value:
        def __getattr__(self, call):
            return lambda *new: calls.append(call) or (values.update(held=new[0]) if new else values.get("held"))

    class Handle:
        def __getattr__(self, kind):
            return lambda *args, **options: Value()

    watch = state.ProfileWatch(most=2, chars=3)
    watch.init(Handle())
    runs = [[(1, "a", "long", ""), (0, "b", "first", " ")], [], [(2, "a", "long", " Ann "), (3, "c", None, "Bob")]]
    got = [[tuple(r) for r in watch.handleInputRows(("p",), (Row(key="p", ord=o, form=f, headline=h, name=n) for o, f, h, n in rows), None)] for rows in runs]
    assert got[0] == [("p", 0, "new", "", ["fir"]), ("p", 1, "changed", "", ["fir", "lon"])] and got[1] == []
    assert got[2] == [("p", 2, "seen", "Ann", ["fir", "lon"]), ("p", 3, "changed", "Ann", ["lon", ""])]
    assert calls == ["get", "update", "get", "get", "update"]


def test_a_source_that_fails_is_empty(spark, tmp_path):
    spark.range(3).selectExpr("id", "'x' as name").write.parquet(f"{tmp_path}/good")
    spark.range(2).selectExpr("'word' as id").write.parquet(f"{tmp_path}/wrong")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "part.parquet").write_bytes(b"PAR1 no more")
    read = lambda name: lambda: spark.read.schema("id long, name string").parquet(f"{tmp_path}/{name}") if name == "cut" else spark.read.parquet(f"{tmp_path}/{name}")
    rows, status = isolated.union_of(spark, {n: read(n) for n in ("good", "missing", "cut", "wrong")}, "id long, name string, note string")
    assert sorted((r.id, r.name, r.note) for r in rows.collect()) == [(i, "x", None) for i in range(3)]
    assert {(r.source, r.status, r.rows) for r in status.collect()} == {("good", "completed", 3), ("missing", "failed", 0), ("cut", "failed", 0), ("wrong", "failed", 0)}
    assert all((r.error != "") == (r.status == "failed") for r in status.collect())
    with pytest.raises(ZeroDivisionError):
        isolated.union_of(spark, {"bug": lambda: 1 / 0}, "id long")
    assert isolated.union_of(spark, {}, "id long")[0].count() == 0
