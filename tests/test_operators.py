from __future__ import annotations

import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import joins, ranking, resolve, rollups, scoring
from tidemark.operators.components import connected_components
from tidemark.plans import evidence, registry
from tidemark.streaming import state
from tidemark.tables import partitions_for


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_brute_force(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 - i, 2000 - 3 * i) for i in range(1, 20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_either_key_join_plans_no_nested_loop(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "z")], "id int, k string, m string")
    right = spark.createDataFrame([(10, "a", "x"), (11, "q", "x"), (12, None, None)], "oid int, k2 string, m2 string")
    out = joins.either_key_join(left, right, [(F.col("k"), F.col("k2")), (F.col("m"), F.col("m2"))], "id", "oid")
    assert sorted((r.id, r.oid or 0) for r in out.collect()) == [(1, 10), (1, 11), (2, 0), (3, 0)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_chain_of_keys_is_one_entity_in_any_order(spark):
    rows = [(1, ["nm:a b"]), (2, ["nm:a b", "li:ab"]), (3, ["li:ab", "gh:x"]), (4, ["gh:x"]), (5, []), (6, ["tw:q"])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, keys array<string>")
        assert {r.id: r.cluster for r in resolve.clusters(df, "id", F.col("keys")).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def test_fold_prefers_longest_then_earliest(spark):
    df = spark.createDataFrame([(1, 1, "ab", "", 3), (1, 2, "abc", "x", None), (1, 3, "xyz", "y", 5)], "cluster long, o int, name string, place string, years int")
    r = resolve.folded(df, F.col("o"), longest=["name"], first=["place"], most=["years"]).first()
    assert (r.name, r.place, r.years, r.n_records) == ("abc", "x", 5, 3)


def test_keep_first_and_blank_keys(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u"), (3, ""), (4, None)], "id int, url string")
    assert sorted(r.id for r in ranking.keep_first(df, "url", ["id"]).collect()) == [1]
    assert sorted(r.id for r in ranking.keep_first(df, "url", ["id"], blank="keep").collect()) == [1, 3, 4]


def test_sentiment_edges(spark):
    m = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(2)] + [("c", 1)], "label string, doc int")
    got = {r.label: r.sentiment for r in rollups.heat_map(["a", "b", "c", "d"], m, "doc").collect()}
    assert got == {"a": "bullish", "b": "neutral", "c": "quiet", "d": "quiet"}


def test_scores_are_their_terms_and_actions_their_edges(spark):
    sig = "array<struct<source:string,signal_type:string,description:string>>"
    rows = [
        ("A B", "Mumbai", "India", "Founder in stealth", "CTO", "Swiggy", "15", True, "u", [("news", "exec_departure", "left"), ("github", "stealth_founder", "stealth")]),
        ("C D", "Paris", "Unknown", "", "", "", None, False, "", []),
        ("E F", "", "Unknown", "", "", "", "x", False, "", [("linkedin", "exec_departure", "")] * 5),
    ]
    schema = f"name string, location string, geography string, headline string, previous_title string, previous_company string, experience_years string, is_second_time_founder boolean, linkedin_url string, signals {sig}"
    got = scoring.rule_score(spark.createDataFrame(rows, schema)).collect()
    assert got[0].score == 100 and got[0].action == "investigate" and len(got[0].badges) <= 5
    assert (got[1].score, got[1].action) == (5, "pass")
    assert got[2].score == 55  # one source, no senior title
    terms = [c for c in got[0].asDict() if c.startswith("t_")]
    assert all(r.score == min(100, sum(r[t] for t in terms)) for r in got if not r.outside and r.name == "A B")


def test_profile_deltas(spark):
    rows = [("p", 0, "A  b"), ("p", 1, "a b"), ("p", 2, "c"), ("", 0, "x"), ("", 1, "x")]
    df = spark.createDataFrame(rows, "k string, ord int, h string")
    got = {(r.k, r.ord): r.delta for r in state.profile_deltas(df, "k", ["ord"], "h").collect()}
    assert got == {("p", 0): "new", ("p", 1): "seen", ("p", 2): "changed", ("", 0): "new", ("", 1): "new"}


def test_merge_json_keeps_types_and_shapes(spark):
    rows = ['{"n":1,"b":true,"o":{"x":[1,2]},"z":null}', "[1]", "{cut", None, '{"a":1,"a":"2"}', '{"b":{"deep":null}}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    extra = '{"b":[true,{"c":1.5}],"new":"é"}'
    got = [json.loads(r.x) for r in df.select(state.merge_json(F.col("j"), F.lit(extra)).alias("x")).collect()]
    held = [json.loads(rows[0]), {}, {}, {}, {"a": "2"}, {"b": {"deep": None}}, {}]
    assert got == [h | json.loads(extra) for h in held]
    got = [json.loads(r.x) for r in df.select(state.merge_json(F.col("j"), F.lit(extra), "enrichment").alias("x")).collect()]
    assert got == [h | {"enrichment": json.loads(extra)} for h in held]


def inserted_one_by_one(table, rows):
    """The ids that inserts return, one after another: by signal, else by profile, else a new row."""
    held = sorted(table)
    top = max((i for i, *_ in held), default=0)
    out = {}
    for order, *keys in sorted(rows):
        found = next((min(h for h in held if h[1 + k] == key)[0] for k, key in enumerate(keys) if key not in (None, "") and any(h[1 + k] == key for h in held)), None)
        if found is None:
            found = top = top + 1
            held.append((found, *keys))
        out[order] = found
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 4, 5, 6]), st.sampled_from(["", None, "a", "b", "c", "d"])), max_size=25), st.integers(0, 4))
def test_inserts_equal_one_by_one(spark, pairs, head):
    table = [(10 + i, s, p) for i, (s, p) in enumerate(pairs[:head])]
    rows = [(i * 3, s, p) for i, (s, p) in enumerate(pairs[head:])]
    t = spark.createDataFrame(table, "id long, signal_id long, profile string")
    r = spark.createDataFrame(rows, "ord long, signal_id long, profile string")
    got = {x.ord: x.id for x in state.insert_claims(t, r, ["signal_id", "profile"], "id", "ord").collect()}
    assert got == inserted_one_by_one(table, rows)


def test_inserts_along_a_chain_and_of_a_hot_key(spark):
    chain = [(i, i // 2 + 1, f"p{(i + 1) // 2}") for i in range(40)] + [(100 + i, 1000 + i, "hot") for i in range(300)] + [(2000, 7, "x"), (2001, 8, "x"), (2002, 7, "y"), (2003, 9, "z")]
    r = spark.createDataFrame(chain, "ord long, signal_id long, profile string")
    t = spark.createDataFrame([], "id long, signal_id long, profile string")
    assert {x.ord: x.id for x in state.insert_claims(t, r, ["signal_id", "profile"], "id", "ord").collect()} == inserted_one_by_one([], chain)
    assert state.insert_absent(t, r, ["signal_id", "profile"], "id", "ord").count() == len(set(inserted_one_by_one([], chain).values()))


def test_upsert_keeps_and_overwrites(spark):
    a = spark.createDataFrame([(1, "x", 1.0)], "k int, first string, v double")
    b = spark.createDataFrame([(1, "y", 2.0), (2, "z", 3.0)], "k int, first string, v double")
    rows = {r["k"]: (r["first"], r["v"]) for r in state.upsert(a, b, "k", keep=["first"], overwrite=["v"]).collect()}
    assert rows == {1: ("x", 2.0), 2: ("z", 3.0)}


def test_a_large_source_lands_in_bounded_files(spark):
    rows = spark.range(2500).select(F.col("id").alias("ord"), F.lit("s").alias("source"))
    files = [r.x for r in evidence._files(rows, F.col("ord"), "x").collect()]
    assert max(map(len, files)) <= 1000 and sorted(sum(files, [])) == list(range(2500))


def test_exists_within_looks_at_the_last_earlier_signal(spark):
    from tidemark.streaming import state

    held = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00'), ('a', timestamp '2024-01-09 00:00:00'), ('b', timestamp '2024-01-05 00:00:00'), (null, timestamp '2024-01-05 00:00:00') as t(k, ts)")
    rows = spark.sql("select * from values (1, 'a', timestamp '2024-01-01 00:00:00'), (2, 'a', timestamp '2024-01-02 00:00:00'), (3, 'a', timestamp '2024-01-08 00:00:00'), (4, 'b', timestamp '2024-01-05 00:00:01'), (5, 'c', timestamp '2024-01-05 00:00:00'), (6, null, timestamp '2024-01-06 00:00:00') as t(id, k, ts)")
    assert sorted(r.id for r in state.exists_within(rows, held, ["k"], "ts", 2).collect()) == [1, 3, 5, 6]


def test_numbered_equals_one_sort(spark):
    from tidemark.operators.ranking import numbered

    df = spark.range(500).selectExpr("id", "id * 7919 % 13 as k").repartition(5)
    got = sorted((r.place, r.k, r.id) for r in numbered(df, ["k", "id"]).collect())
    assert got == [(i + 1, k, x) for i, (k, x) in enumerate(sorted((i * 7919 % 13, i) for i in range(500)))]


def test_hygiene_cleans_names_once(spark, monkeypatch):
    """Clusters read their records several times: what they are given must hold no work on texts that is still to do."""
    plans, plain = [], resolve.clusters
    monkeypatch.setattr(resolve, "clusters", lambda records, *a: plans.append(records._jdf.queryExecution().optimizedPlan().toString()) or plain(records, *a))
    df = spark.createDataFrame([(1, "Asha Rao 14 ☀", "", "s1"), (2, "asha rao", "", "s2"), (3, "ASHA RAO", "linkedin.com/in/ar", "s2"), (4, None, "linkedin.com/in/x", "s3"), (5, "Bo Li", "", None)], "id long, name string, li string, src string")
    df = df.withColumns({"tw": F.lit(""), "gh": F.lit(None).cast("string")})
    got = resolve.hygiene(df, "id", "name", "li", "tw", "gh", F.col("src"), F.col("n_records") >= 1).select("cluster", "n_records", "n_evidence", "name").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 2, "Asha Rao"), (5, 1, 1, "Bo Li")]
    assert len(plans) == 1 and "regexp_replace" not in plans[0]


def _fullest(df):
    """The share of the rows that the fullest partition has."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts) if counts else 0


def test_rows_without_a_key_are_dealt_to_all_tasks(spark, monkeypatch):
    """Half of the outreach rows have no signal, most inserts lack a key: joined by it they would all be in one task."""
    with state.session_with(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"):
        out = registry.queries()["j02_outreach_signals"](spark, "/root/testdata/sf0.001")
        keyed = joins.left_by_key(spark.range(1000), spark.range(500).toDF("o"), F.when(F.col("id") % 10 == 0, F.col("id")), "o")
        assert sorted((r.id, r.o) for r in keyed.collect()) == [(i, i if i % 10 == 0 and i < 500 else None) for i in range(1000)]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "isnull(" in plan  # those without a key stay out of the join
        shares, plain = [], state.materialise
        monkeypatch.setattr(state, "materialise", lambda df, *by: shares.append(_fullest(df)) or plain(df, *by))
        table = spark.range(400, 500).select("id", F.col("id").alias("s"), F.lit(None).cast("string").alias("l"))
        rows = spark.range(4000).repartition(16).select((F.col("id") + 1).alias("ord"), F.when(F.col("id") % 20 == 0, F.col("id")).alias("s"), F.when(F.col("id") % 50 == 0, F.lit("x")).otherwise(" ").alias("l"))
        got = {r.ord: r.id for r in state.insert_claims(table, rows, ["s", "l"], "id", "ord").collect()}
    held, link, top, want = {400 + i: 400 + i for i in range(100)}, {}, 499, {}
    for i in range(4000):
        s, x = i if i % 20 == 0 else None, i % 50 == 0
        found = held.get(s) or (link.get("x") if x else None)
        if not found:
            top += 1
            found = top
            if s is not None:
                held[s] = found
            if x:
                link["x"] = found
        want[i + 1] = found
    assert got == want and max(shares[:3]) < 0.5


def test_partitions_follow_the_rows(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark, 10) == usual and partitions_for(spark, 500_000 * (usual + 3) + 1) == usual + 4
