"""Dictionary and name matches against plain loops."""

from __future__ import annotations

import random
import re

from tidemark.operators import lexicon
from tidemark.tables import materialise


def test_substrings_equal_a_plain_search(spark):
    rng = random.Random(5)
    texts = ["", None, "A", "çé😀 abc", "x" * 5000 + "ab cd", *("".join(rng.choice("ab cé😀") for _ in range(rng.randint(1, 60))) for _ in range(120))]
    words = ["a", "AB", "ab cd", "é😀", "😀", "", " ", None, "zzzz", "xxxxx", *("".join(rng.choice("ab cé") for _ in range(rng.randint(1, 7))) for _ in range(150))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "ab")], "id long, body string")
    d = spark.createDataFrame([(f"l{i % 60}", w) for i, w in enumerate(words)], "label string, keyword string")
    for gram in (2, 4):
        got = {(r.id, r.label) for r in lexicon.substring_matches(docs, "id", "body", d, gram, rare_in=3).collect()}
        assert got == {(i, f"l{k % 60}") for i, t in enumerate(texts) for k, w in enumerate(words) if w and w.strip(" ") and t and w.lower() in t.lower()}
    assert lexicon.substring_matches(docs, "id", "body", d.where("false")).count() == 0


def test_plan_does_not_grow_with_the_dictionary(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "id long, body string")
    size = lambda n: len(lexicon.substring_matches(docs, "id", "body", spark.range(n).selectExpr("cast(id as string) as label", "concat('abcd', id) as keyword"))._jdf.queryExecution().analyzed().toString())
    assert abs(size(2000) - size(20)) < 300


def test_mentions_equal_a_plain_search(spark):
    rng = random.Random(6)
    pool = ["Priya", "Nair", "nair", "ex", "former", "at", "previously", "Grab", "e", "é"]
    texts = [None, "", "Priya Nair", *(rng.choice([" ", ", ", "-"]).join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    names = ["Priya Nair", "Nair", "PRIYA  nair!", "grab", "Priya at Grab", "", "..", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    want = []
    for i, t in enumerate(texts):
        w = split(t)
        for name in names:
            n = split(name)
            want += [(i, name, k + 1, w[max(0, k - 2) : k], " ".join(w[max(0, k - 5) : k + len(n) + 5])) for k in range(len(w) - len(n) + 1) if n and w[k : k + len(n)] == n]
    got = lexicon.mentions(docs, "id", "body", spark.createDataFrame([(n,) for n in names], "who string"), "who").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    gone = {(i, n) for i, n, _, b, _ in want if n == "grab" and b and (b[-1] in lexicon.FORMER or b[-2:] == ["previously", "at"])}
    held = {i for i, n, *_ in want if n == "grab"}
    rows = lexicon.employed(docs, "id", "body", spark.createDataFrame([("Grab",)], "c string"), "c").collect()
    assert {r.id: r.employed for r in rows} == {i: i in held and (i, "grab") not in gone for i in range(len(texts))}


def test_a_run_that_the_sample_lacks_brings_no_candidates(spark, monkeypatch):
    """Numbers that stand in the texts are rare in the sample, but what stands before them in the keywords is in no text: none is searched for."""
    docs = spark.range(400).selectExpr("id as doc", "concat_ws(' ', transform(sequence(0, 20), i -> lpad(pmod(xxhash64(id, i), 10000), 4, '0'))) as text")
    words = spark.range(3000).selectExpr("id as label", "'cust#' || lpad(pmod(id * 7919, 1000000), 6, '0') as keyword").unionByName(docs.where("doc = 7").selectExpr("-doc as label", "substring(text, 3, 9) as keyword"))
    written = []
    monkeypatch.setattr(lexicon, "materialise", lambda df, *by: written.append(materialise(df, *by)) or written[-1])
    got = lexicon.substring_matches(docs, "doc", "text", words)
    assert [tuple(r) for r in got.collect()] == [(7, -7)]
    found = next(t for t in written if t.columns == ["doc", "keyword"])
    assert found.count() < 10


def test_no_text_is_searched_whole_for_each_keyword(spark, monkeypatch):
    """Keywords that many texts hold are met at their places: no text is joined to a keyword and searched from its start."""
    plans = []
    monkeypatch.setattr(lexicon, "materialise", lambda df, *by: plans.append(df) or materialise(df, *by))
    docs = spark.range(20).selectExpr("id", "concat_ws(' ', transform(sequence(0, 50), i -> concat('w', i, id % 3))) as body")
    d = spark.range(60).selectExpr("concat('l', id) as label", "if(id % 5 = 0, concat('w', id, '0'), concat(id, '1 w', id + 1)) as keyword")
    got = lexicon.substring_matches(docs, "id", "body", d)
    want = {(i, f"l{k}") for i in range(20) for k in range(60) if (f"w{k}0" if k % 5 == 0 else f"{k}1 w{k + 1}") in " ".join(f"w{j}{i % 3}" for j in range(51))}
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == sorted(want)
    text = [str(df._jdf.queryExecution().optimizedPlan()) for df in (*plans, got)]
    assert not any("Contains(_text" in t for t in text)


def test_substrings_with_spaces_at_odd_places(spark, monkeypatch):
    """Keywords that begin, end or go on with spaces, of many words, that share all windows or their labels, as small and as large tables."""
    rng = random.Random(7)
    pool = ["a", "b", "ab", "ba", "é", "😀b", "", "\n", "aab\tb"]
    draw = lambda low, high: " ".join(rng.choice(pool) for _ in range(rng.randint(low, high)))
    texts = [None, "", " ", "a", "a ", " a", "  ", *(draw(1, 40) for _ in range(80)), " ".join(["ab"] * 400)]
    words = ["a ", " a", "  a", "a  ", "\n ", "ab ab", " ".join(["ab"] * 12), " ".join(["ab"] * 12) + " c", " ".join(["b"] * 9), "none of these", "a" * 40 + " b", *(draw(1, 4) for _ in range(120)), *(t[1:40] for t in texts[10:30])]
    d = [(f"l{i % 40}", w) for i, w in enumerate(words)] + [(f"m{i}", w) for w in ("AB A", "ab") for i in range(30)]
    docs = spark.createDataFrame([(i % 60, t) for i, t in enumerate(texts)] + [(None, "a b")], "id int, body string")
    want = sorted({(i % 60, label) for i, t in enumerate(texts) for label, w in d if t and w.strip(" ") and w.lower() in t.lower()})
    for shared, small, many in ((128, 200_000, 16), (2, 0, 1)):
        for name, value in (("SHARED", shared), ("SMALL", small), ("MANY", many)):
            monkeypatch.setattr(lexicon, name, value)
        got = lexicon.substring_matches(docs, "id", "body", spark.createDataFrame(d, "label string, keyword string"))
        assert sorted(map(tuple, got.collect())) == want


def test_keys_of_any_name(spark):
    docs, d = spark.createDataFrame([(1, "an old red car"), (2, "redcar")], "k int, body string"), spark.createDataFrame([("x", "old red"), ("y", "dcar"), ("z", "D C")], "label string, keyword string")
    for name in ("window", "head", "rest", "n", "a", "w", "gram", "size"):
        got = lexicon.substring_matches(docs.withColumnRenamed("k", name), name, "body", d)
        assert sorted(map(tuple, got.collect())) == [(1, "x"), (1, "z"), (2, "y")]


def test_mentions_of_long_names_and_equal_rows(spark):
    """Names longer than what they are looked up by, which begin alike; rows that share their key, have none, or are equal."""
    long = " ".join(f"w{i}" for i in range(12))
    names = [long, long + " x", long[:-4] + " y", "w3 w4"]
    texts = [(1, f"a {long} x", "p"), (1, f"a {long} x", "q"), (1, "b, W3-w4", "p"), (None, "w3 w4", "p"), (None, "w3 w4", "p"), (2, None, "p"), (2, long[:-4], "p")]
    got = lexicon.mentions(spark.createDataFrame(texts, "id long, body string, k string"), "id", "body", spark.createDataFrame([(n,) for n in names], "who string"), "who", keep=["k"]).collect()
    want = []
    for i, t, k in texts:
        w = re.findall(r"\w+", (t or "").lower())
        for n in (x.split() for x in names):
            want += [(i, " ".join(n), p + 1, w[max(0, p - 2) : p], " ".join(w[max(0, p - 5) : p + len(n) + 5]), k) for p in range(len(w) - len(n) + 1) if w[p : p + len(n)] == n]
    assert len(want) == 10 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_what_stands_around_is_made_for_mentions_alone(spark):
    """Nothing is joined to a string for each place of a text, and no filter makes the places a second time."""
    docs = spark.range(3).selectExpr("id", "concat('ann lee ', id) as body")
    plan = lexicon.mentions(docs, "id", "body", spark.createDataFrame([("Ann Lee",)], "who string"), "who")._jdf.queryExecution().optimizedPlan().toString()
    places = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert len(places) == 1 and "lambda" not in places[0]
    assert plan.count("arrays_zip") == 1
