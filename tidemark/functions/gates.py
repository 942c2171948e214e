"""Filters as boolean Columns; their dictionaries are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import words as W
from tidemark.functions.text import any_of, text_of


def news_relevant(text: Column, wanted: Sequence[str] = (*W.DEPARTURE, *W.FOUNDING, *W.FUNDING), excluded: Sequence[str] = W.EXCLUDED) -> Column:
    """No excluded term and any wanted one."""
    return ~any_of(text, excluded) & any_of(text, wanted)


def topic_relevant(text: Column, relevant: Sequence[str], irrelevant: Sequence[str]) -> Column:
    return ~any_of(text, irrelevant) & any_of(text, relevant)


def strictly_relevant(text: Column, strong: Sequence[str], relevant: Sequence[str], context: Sequence[str], irrelevant: Sequence[str]) -> Column:
    """A strong term, or a relevant one together with a term of region or technology; never an irrelevant one."""
    return ~any_of(text, irrelevant) & (any_of(text, strong) | (any_of(text, relevant) & any_of(text, context)))


def headline_gate(title: Column, snippet: Column, junior: Sequence[str] = ("intern", "student", "fresher"), vocabulary: Sequence[str] = ("stealth", "founder", "building")) -> Column:
    """``(has_stealth, has_senior)``; a junior term in the title clears both."""
    junior_ = any_of(title, junior)
    return F.struct((~junior_ & any_of(title, vocabulary)).alias("has_stealth"), (~junior_ & any_of(F.concat_ws(" ", title, snippet), W.SENIOR_SNIPPET)).alias("has_senior"))


def first_person_post(text: Column) -> Column:
    """Someone's own post: first person, and not a bot's list or relay."""
    low = F.lower(text_of(text))
    return ~low.rlike(r"is now building in stealth|via @|\brt @|top \d+ ") & low.rlike(r"\b(?:i|i'm|i've|my|we|we're|our)\b")


def within(ts: Column, as_of: str, days: int) -> Column:
    """No older than so many days before ``as_of``, a literal, so that it prunes partitions and row groups."""
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def plausible(types: Column, evidence: Column, structural: Sequence[str], pattern: str) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, structural))) | F.lower(text_of(evidence)).rlike(pattern)


def actionable(name: Column, *anchors: Column) -> Column:
    return (F.trim(text_of(name)) != "") | reduce(lambda a, b: a | b, (F.trim(text_of(x)) != "" for x in anchors))


def search_terms(df: DataFrame, query: str, columns: Sequence[str], most: int = 6, least_chars: int = 2) -> DataFrame:
    """Rows where every term of the query stands in one of the columns."""
    terms = [t for t in query.lower().split() if len(t) >= least_chars][:most]
    for t in terms:
        df = df.where(reduce(lambda a, b: a | b, (F.lower(text_of(F.col(c))).contains(t) for c in columns)))
    return df


def api_filter(df: DataFrame, source: str | None = None, action: str | None = None, geo: str | None = None) -> DataFrame:
    """Optional predicates: source holds, action is the recommended one or the stage, geography (else location) holds."""
    if source:
        df = df.where(F.lower("source").contains(source.lower()))
    if action:
        df = df.where((F.col("recommended_action") == action) | (F.col("stage") == action))
    if geo:
        df = df.where(F.lower(F.coalesce(F.nullif("geography", F.lit("")), "location")).contains(geo.lower()))
    return df


def listed_source(url: Column, title: Column, domains: Sequence[str], terms: Sequence[str]) -> Column:
    return any_of(url, domains) | any_of(title, terms)


def headcount_change(growth_pct: Column, text: Column, grow: Sequence[str] = ("hiring", "doubled"), shrink: Sequence[str] = ("layoff", "downsizing"), least: float = 40) -> Column:
    """``growth`` or ``shrink`` by the given figure, else by words, growth first; null where neither."""
    return F.when(growth_pct >= least, "growth").when(growth_pct.isNull() & any_of(text, grow), "growth").when(growth_pct.isNull() & any_of(text, shrink), "shrink")


def score_gate(score: Column, configured: float, floor: float = 30) -> Column:
    return score >= max(configured, floor)
