"""Entities over runs against one full run."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators.entities import Entities
from tests.test_operators import brute


def test_entities_over_runs_equal_one_run(spark, tmp_path):
    rng = random.Random(2)
    records = [(i, ["hot"] if i % 11 == 5 else [f"k{rng.randint(0, 60)}" for _ in range(rng.randint(0, 2))]) for i in rng.sample(range(1000), 120)]
    held = Entities(spark, str(tmp_path / "e"), buckets=16)
    names: dict[int, int] = {}
    for run in range(4):
        news = spark.createDataFrame(records[run * 30 : run * 30 + 30], "id long, keys array<string>")
        gone = {r.entity: r.into for r in held.add(news, "id", F.col("keys")).collect()}
        got = {r.id: r.entity for r in held.resolved().collect()}
        so_far = records[: run * 30 + 30]
        want = brute([(("id", i), ("key", k)) for i, ks in so_far for k in ks] + [(("id", i), ("id", i)) for i, _ in so_far])
        groups: dict = {}
        for i, _ in so_far:
            groups.setdefault(want[("id", i)], set()).add(i)
        mine: dict = {}
        for i, e in got.items():
            mine.setdefault(e, set()).add(i)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
        assert all(e in members for e, members in mine.items())
        assert all(got[i] == gone.get(e, e) for i, e in names.items())  # a name stays, or is retired with what it became
        names = got


def test_a_run_touches_only_its_buckets(spark, tmp_path):
    held = Entities(spark, str(tmp_path / "e"), buckets=32)
    held.add(spark.createDataFrame([(i, [f"k{i}"]) for i in range(200)], "id long, keys array<string>"), "id", F.col("keys"))
    before = held.keys.manifest(), held.records.manifest()
    held.add(spark.createDataFrame([(500, ["k3", "k7", "new"]), (501, None)], "id long, keys array<string>"), "id", F.col("keys"))
    after = held.keys.manifest(), held.records.manifest()
    assert sum(before[0][b] != after[0].get(b) for b in before[0]) == 1  # that of the new key
    assert sum(before[1].get(b) != after[1][b] for b in after[1]) <= 2
    assert {r.id: r.entity for r in held.resolved().where("id in (3, 7, 500, 501)").collect()} == {3: 3, 7: 3, 500: 3, 501: 501}
