"""Explainable scores: every term is a column, the score their capped sum."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import words as W
from tidemark.functions.text import any_of, is_senior, text_of


def snippet_score(text: Column, stealth: Sequence[tuple[str, int]] = W.STEALTH, excluded: Sequence[str] = W.EXCLUDED) -> Column:
    """20; 8 for each stealth entry, 12 senior, 10 pedigree, 15 serial; 85 at most; 0 with an excluded term."""
    low = F.lower(text_of(text))
    points = reduce(lambda a, b: a + b, (F.when(low.contains(t), 8 * n).otherwise(0) for t, n in stealth), F.lit(20))
    points += F.when(any_of(text, W.SENIOR_SNIPPET), 12).otherwise(0) + F.when(any_of(text, W.PEDIGREE), 10).otherwise(0)
    points += F.when(any_of(text, ("second-time", "serial")), 15).otherwise(0)
    return F.when(any_of(text, excluded), 0).otherwise(F.least(points, F.lit(85)))


def type_weight(kind: Column, weights: Sequence[tuple[str, int]] = W.SIGNAL_WEIGHTS, cap: int = 18) -> Column:
    """A type's weight: its own, else that of the first listed type that holds it or that it holds; capped."""
    k = F.replace(F.lower(kind), F.lit(" "), F.lit("_"))
    exact = F.create_map(*(F.lit(x) for kv in weights for x in kv))[k]
    partial = F.coalesce(*(F.when(k.contains(name) | F.lit(name).contains(k), F.lit(w)) for name, w in weights), F.lit(0))
    return F.least(F.coalesce(exact, partial), F.lit(cap))


def rule_score(persons: DataFrame) -> DataFrame:
    """``persons`` with a column for each term, ``score``, ``action``, ``fit``, ``founder_type``, ``confidence``, ``strengths``, ``risks``, ``thesis`` and ``badges``.

    It reads name, location, geography, headline, previous_title, previous_company, experience_years,
    is_second_time_founder, linkedin_url and signals (source, signal_type, description and, where like signals stand as one, times).
    A location outside the regions gives 5 and ``pass`` whatever else holds.
    """
    counted = "times" in persons.schema["signals"].dataType.elementType.names
    times = (lambda s: s["times"].cast("int")) if counted else (lambda s: F.lit(1))
    summed = lambda value: F.aggregate(F.transform("signals", value), F.lit(0), lambda a, x: a + x)
    types = F.array_distinct(F.transform("signals", lambda s: F.replace(F.lower(s["signal_type"]), F.lit(" "), F.lit("_"))))
    has = lambda *names: F.arrays_overlap(F.col("types"), F.array(*map(F.lit, names)))
    said = F.lower(F.array_join(F.transform("signals", lambda s: text_of(s["description"])), " "))
    p = persons.withColumns({"types": types, "n_signals": summed(times), "sources": F.array_sort(F.array_distinct(F.transform("signals", lambda s: s["source"])))})
    p = p.withColumns({"said": said, "title": F.trim(text_of(F.col("previous_title"))), "years": F.coalesce(F.col("experience_years").try_cast("int"), F.lit(0))})
    p = p.withColumn("senior", (F.col("title") != "") & is_senior(F.col("title")))
    gazetteer = tuple(w for _, ws in W.REGIONS for w in ws)
    inside = (F.col("geography") != "Unknown") | any_of(F.col("location"), gazetteer) | any_of(F.col("said"), gazetteer)
    blank = F.lower(F.trim(text_of(F.col("location")))).isin("", *W.PLACEHOLDER_NAMES)
    head = F.lower(text_of(F.col("headline")))
    seen = F.concat_ws(" ", F.lower(text_of(F.col("previous_company"))), head, F.lower(F.array_join(F.transform(F.slice("signals", 1, 2), lambda s: text_of(s["description"])), " ")))
    ladder = lambda c, *steps: reduce(lambda rest, s: F.when(c >= s[0], s[1]).otherwise(rest), reversed(steps), F.lit(0))
    terms = {
        "t_base": F.lit(22),
        "t_region": F.when(inside, 8).otherwise(0),
        "t_signals": summed(lambda s: type_weight(s["signal_type"]) * times(s)),
        "t_second_time": F.when(F.col("is_second_time_founder"), 20).otherwise(0),
        "t_years": ladder(F.col("years"), (15, 15), (10, 10), (7, 5)),
        "t_profile": F.when(text_of(F.col("linkedin_url")) != "", 7).otherwise(0),
        "t_senior": F.when(F.col("senior") | ((F.col("title") == "") & any_of(F.concat_ws(" ", head, "said"), W.SENIOR)), 10).otherwise(0),
        "t_pedigree": F.when(any_of(seen, W.PEDIGREE), 8).otherwise(0),
        "t_headline": F.when(any_of(head, ("stealth", "building")), 8).otherwise(0) + F.when(head.contains("founder"), 6).otherwise(0),
        "t_text": F.when(any_of(F.col("said"), ("stealth", "building something")), 6).otherwise(0) + F.when(any_of(F.col("said"), ("ex-", "former", "left")), 4).otherwise(0),
        "t_sources": ladder(F.size("sources"), (3, 12), (2, 6)),
        "t_count": ladder(F.col("n_signals"), (4, 10), (2, 5)),
    }
    p = p.withColumns({**terms, "outside": ~inside & ~blank})
    total = reduce(lambda a, b: a + b, map(F.col, terms))
    alone = (F.col("sources") == F.array(F.lit("linkedin"))) & ~F.col("senior") & ~has("stealth_headline_change")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.when(alone, F.least(total, F.lit(55))).otherwise(total)))
    p = p.withColumn("score", F.when(F.col("outside"), 5).otherwise(score))
    action = F.when(F.col("score") >= 60, "investigate").when(F.col("score") >= 42, "watchlist").otherwise("pass")
    fit = F.when(F.col("score") >= 60, "strong").when(F.col("score") >= 42, "moderate").otherwise("weak")
    kind = (
        F.when(F.col("is_second_time_founder") | has("second_time_founder"), "second_time_founder")
        .when(F.col("senior") & (F.col("years") >= 10), "seasoned_operator")
        .when(F.col("years") >= 5, "first_time_founder")
        .otherwise("unknown")
    )
    sure = F.when((F.col("n_signals") >= 3) & (F.size("sources") >= 2), "high").when(F.col("n_signals") >= 2, "medium").otherwise("low")
    listed = lambda most, default, *items: (lambda found: F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))), 1, most))(F.filter(F.array(*items), lambda x: x.isNotNull()))
    strengths = listed(
        4, "Signal detected from sourcing pipeline",
        F.when(F.col("is_second_time_founder"), "Second-time founder"),
        F.when(F.col("years") >= 10, F.concat("years", F.lit("+ years of experience"))),
        F.when(F.col("senior"), F.concat(F.lit("Senior role: "), "title")),
        F.when(has("company_registration", "mca_registration"), "Company registration signal detected"),
        F.when(has("stealth_founder", "exec_departure"), "Active departure / stealth signal"),
        F.when(F.size("sources") >= 2, F.concat(F.lit("Corroborated across "), F.size("sources"), F.lit(" sources"))),
    )
    risks = listed(
        3, "Early stage — limited public information",
        F.when(F.col("n_signals") < 2, "Single signal — needs corroboration"),
        F.when(F.col("years") < 7, "Limited experience (<7 yrs)"),
        F.when(F.col("geography") == "Unknown", "Geography unconfirmed"),
        F.when(F.col("title") == "", "Previous role unclear"),
    )
    p = p.withColumns({"action": action, "fit": fit, "founder_type": kind, "confidence": sure, "strengths": strengths, "risks": risks})
    p = p.withColumns({"thesis": thesis(), "badges": badges(has)})
    hard = {"action": F.lit("pass"), "fit": F.lit("weak"), "founder_type": F.lit("unknown"), "confidence": F.lit("high"), "strengths": F.array().cast("array<string>"), "risks": F.array(F.lit("Location outside the regions"))}
    return p.withColumns({k: F.when(F.col("outside"), v).otherwise(F.col(k)) for k, v in hard.items()})


def thesis() -> Column:
    """One templated sentence by action, with the first three types in order of name."""
    who = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("This person"))
    firm = F.coalesce(F.nullif(F.trim("previous_company"), F.lit("")), F.lit("a notable company"))
    past = F.when(F.col("title") != "", F.concat(F.lit("ex-"), "title", F.lit(" at "), firm)).otherwise(F.concat(F.lit("ex-"), firm))
    said = F.concat(F.lit(" Signals: "), F.replace(F.array_join(F.slice(F.array_sort("types"), 1, 3), ", "), F.lit("_"), F.lit(" ")), F.lit("."))
    end = F.when(F.col("action") == "investigate", " is a strong early lead.").when(F.col("action") == "watchlist", " is worth watching.").otherwise(" has too little evidence so far.")
    return F.concat(who, F.lit(" ("), past, F.lit(")"), end, F.when(F.size("types") > 0, said).otherwise(""))


def badges(has) -> Column:
    """Five badges at most."""
    company = F.concat_ws(" ", F.lower(text_of(F.col("previous_company"))), F.lower(text_of(F.col("headline"))))
    items = F.array(
        F.when(has("stealth_headline_change"), "Just went stealth"),
        F.when(has("accelerator_batch"), "YC batch"),
        F.when(F.col("is_second_time_founder"), "2x founder"),
        F.when(any_of(company, W.PEDIGREE), "Ex-unicorn/top co"),
        F.when(F.col("years") >= 10, F.concat("years", F.lit("y operator"))),
        F.when(has("seniority_corroborated", "profile_verified"), "Verified"),
        F.when(F.size(F.array_except("sources", F.array(F.lit("verification")))) >= 2, "Multi-source"),
        F.when(F.col("senior"), F.concat(F.lit("Ex-"), "title")),
    )
    return F.slice(F.filter(items, lambda x: x.isNotNull()), 1, 5)


def with_education_badge(badges: Column, school: Column, most: int = 6) -> Column:
    return F.slice(F.when(text_of(school) != "", F.concat(badges, F.array(school))).otherwise(badges), 1, most)


def demoted(df: DataFrame, action: str, stage: str) -> DataFrame:
    """A later funding stage turns investigate into watchlist, with the reason."""
    late = (F.col(stage) == "later_stage") & (F.col(action) == "investigate")
    return df.withColumn("reason", F.when(late, "later-stage company").otherwise("")).withColumn(action, F.when(late, "watchlist").otherwise(F.col(action)))


def preferred_score(rules: DataFrame, given: DataFrame, key: str, configured: float, floor: float = 30) -> DataFrame:
    """A given score wins over the rules' one; rows below the larger threshold go; best first."""
    both = rules.join(given.select(key, F.col("score").alias("_given")), key, "left").withColumn("score", F.coalesce("_given", "score")).drop("_given")
    return both.where(F.col("score") >= max(configured, floor)).orderBy(F.desc("score"), key)


def percent_change(price: Column, previous: Column) -> Column:
    return F.round(F.when(previous != 0, (price - previous) / previous * 100).otherwise(0), 2)
