"""Column functions on inline rows: stated examples and regressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import gates, text as T
from tidemark.operators import scoring
from tidemark.sources import landed


def one(spark, make, *values, types=None):
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(types or ["string"] * len(values)))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("Vaibhav Singh 1409", "Vaibhav Singh"), ("unknown", ""), ("-", ""), (None, ""), ("PRIYA NAIR", "Priya Nair"), ("priya o'neil-rao", "Priya O'Neil-Rao"), ("Ｐｒｉｙａ Nair ☀", "Priya Nair"), ("Cher", "Cher"), ("12", ""), ("Priya Nair (he/him)", "Priya Nair"), ("Priya Nair (ex-Grab)", "Priya Nair"), ("Priya Nair (she/her), (ex-Grab) 🚀", "Priya Nair"), ("Priya (Pri) Nair", "Priya (Pri) Nair")],
)
def test_clean_name(spark, raw, clean):
    assert one(spark, lambda c: T.clean_name(c, unicode_form=True), raw) == clean


def test_slug_names(spark):
    assert one(spark, T.name_from_slug, "arjun-mehta-abc123") == "Arjun Mehta"
    assert one(spark, T.name_from_slug, "venkatesanv") == ""
    assert one(spark, lambda c: T.name_from_slug(c, strict=False), "arjun-mehta-abcdefgh") == "Arjun Mehta"


def test_years(spark):
    fresh = lambda t: one(spark, lambda c: T.freshen_years(c, 2026), t)
    assert fresh("founder 2025") == "founder 2026"
    assert fresh("2024 OR 2025") == "2025 OR 2026"
    assert fresh("2026 OR 2025") == "2026 OR 2025"
    assert fresh("no year") == "no year"


def test_batch_key(spark):
    assert tuple(one(spark, T.batch_key, "Winter 2025")) == (2025, 0)
    assert tuple(one(spark, T.batch_key, "soon")) == (0, 0)
    assert tuple(one(spark, T.batch_key, None)) == (0, 0)


def test_evidence_keys_ignore_case_and_slash(spark):
    a = one(spark, lambda c: T.evidence_key(c, F.lit("")), "https://Ex.com/A/")
    assert a == one(spark, lambda c: T.evidence_key(c, F.lit("")), "https://ex.com/a")


def test_flags(spark):
    assert one(spark, lambda c: T.foreign_flag(c, ["\U0001f1ee\U0001f1f3"]), "Founder \U0001f1fa\U0001f1f8")
    assert not one(spark, lambda c: T.foreign_flag(c, ["\U0001f1ee\U0001f1f3"]), "Founder \U0001f1ee\U0001f1f3")


def test_former_company(spark):
    found = lambda t: tuple(one(spark, lambda c: T.former_at(c, F.lit("Urban Company")), t))
    assert found("Cofounder & CEO of Urban Company") == ("", True)
    assert found("ex - Urban Company, building") == ("Urban Company", False)


def test_company_word_boundary(spark):
    from tidemark.operators.joins import currently_employed

    df = spark.createDataFrame([("Works at Olark",), ("Works at Ola",), ("ex-Ola",)], "t string")
    assert [r.x for r in df.select(currently_employed(df, "t", ["ola"]).alias("x")).collect()] == [False, True, False]


def test_bot_posts(spark):
    assert not one(spark, gates.first_person_post, "X is now building in Stealth, my list")
    assert one(spark, gates.first_person_post, "I'm building something")


def test_headline_key_and_dates(spark):
    assert one(spark, T.headline_key, "  A   b ") == "a b"
    assert str(one(spark, T.parse_date, "Wed, 03 Jan 2024 04:05:06 +0000")) == "2024-01-03 04:05:06"
    assert one(spark, lambda c: T.parse_date(c, None), "x") is None


def test_star_text(spark):
    assert one(spark, landed.star_count, "1,234") == 1234
    assert one(spark, landed.star_count, "1.2k") == 1200
    assert one(spark, landed.star_count, "many") is None


def test_type_weights(spark):
    assert one(spark, scoring.type_weight, "stealth_headline_change") == 18
    assert one(spark, scoring.type_weight, "twitter_announcement") == 10
    assert one(spark, scoring.type_weight, "github_launch") == 0


def test_work_facts(spark):
    stints = [("Acme", "CTO", 2010, 2015), ("Stealth", "Founder", 2016, None)]
    df = spark.createDataFrame([(stints,)], "s array<struct<company:string,title:string,start_year:int,end_year:int>>")
    got = df.select(T.work_facts(F.col("s"), 2026).alias("w")).first().w
    assert (got.previous_title, got.previous_company, got.years, got.current_company, got.stealth) == ("CTO", "Acme", 16, "Stealth", True)


def test_model_rows_survive_prose_and_bad_indexes(spark):
    raw = [("b", 2, 'Here: [{"idx":0,"person":"A B","event":"departure"},{"idx":5,"person":"C"},{"idx":1,"person":"none","event":""}] ok'), ("c", 2, "no json")]
    rows = landed.extraction_rows(spark.createDataFrame(raw, "batch_id string, batch_size int, raw_text string")).collect()
    assert [(r.idx, r.person) for r in rows] == [(0, "A B"), (1, None)]


@pytest.mark.parametrize(
    ("title", "summary", "name"),
    [
        ("Priya Nair quits Acme to start up", "", "Priya Nair"),
        ("Why Former Acme VP Arjun Mehta is back", "", "Arjun Mehta"),
        ("Fund led by Zoë O'Neil closes", "", "Zoë O'Neil"),
        ("Quiet week", "Anita Rao Kulkarni, the co-founder, spoke", "Anita Rao Kulkarni"),
        ("New Delhi hosts Tech Group", "", "Unknown"),
        ("Digital India launches", "nothing", "Unknown"),
        (None, None, "Unknown"),
    ],
)
def test_person_name(spark, title, summary, name):
    assert one(spark, T.person_name, title, summary) == name


@pytest.mark.parametrize(("text", "company"), [("She left Acme Labs today", "Acme Labs"), ("resigned from Grab", "Grab"), ("ex-Swiggy CTO", "Swiggy"), ("Former Acme VP speaks", "Acme"), ("nobody", ""), (None, "")])
def test_previous_company(spark, text, company):
    assert one(spark, T.previous_company, text) == company
