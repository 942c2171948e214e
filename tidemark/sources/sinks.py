"""Report tables and the slices that writers replace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import text_of
from tidemark.operators.ranking import numbered, top_per_group


def dashboard_json(persons: DataFrame, key: str, most: int = 8) -> DataFrame:
    """One JSON text per person with its first signals, ready for a text or JSON writer."""
    return persons.select(key, F.to_json(F.struct(*(c for c in persons.columns if c != "signals"), F.slice("signals", 1, most).alias("signals"))).alias("json"))


def source_breakdown(signals: DataFrame) -> DataFrame:
    """One row: a map of source to count, and the total."""
    n = signals.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.sum("n").alias("total"))


def first_signals(signals: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``key, signals``: the first ``most`` signals of each key in order, as ``source, signal_type, description``. Ranks are cut before they shuffle, so a key with any number of signals costs ``most``."""
    kept = top_per_group(signals, [key], [F.col(order)], most)
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "source", "signal_type", "description")))
    return kept.groupBy(key).agg(F.transform(listed, lambda x: F.struct(x["source"].alias("source"), x["signal_type"].alias("signal_type"), x["description"].alias("description"))).alias("signals"))


def dashboard_export(persons: DataFrame, signals: DataFrame, key: str, order: str, rank: Sequence[Column], most: int = 8) -> DataFrame:
    """The dashboard as lines ``ord, json``: first totals and the map of sources, then each person in order of ``rank`` with the first signals.

    One table to write as text, whose lines are read apart or together: no row holds all persons.
    """
    held = persons.join(first_signals(signals, key, order, most), key, "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<struct<source:string,signal_type:string,description:string>>")))
    lines = numbered(held, rank, "ord").select("ord", F.to_json(F.struct(*persons.columns, "signals")).alias("json"))
    head = source_breakdown(signals).crossJoin(persons.agg(F.count(F.lit(1)).alias("n")))  # one row each
    head = head.select(F.lit(0).cast("long").alias("ord"), F.to_json(F.struct(F.col("n").alias("total_persons"), F.coalesce("total", F.lit(0)).alias("total_signals"), F.col("sources").alias("source_breakdown"))).alias("json"))
    return head.unionByName(lines)


#: What the digest calls actions and types of signals.
ACTIONS = {"investigate": "🟢 INVESTIGATE", "watchlist": "🟡 WATCHLIST", "pass": "🔴 PASS"}
BADGES = {
    "stealth_founder": "🥷 Stealth", "executive_departure": "🚪 Departure", "github_launch": "🐙 GitHub", "funding_news": "💰 Funding", "company_registration": "🏢 Registry",
    "twitter_announcement": "🐦 Twitter", "headcount_growth": "📈 Growth", "headcount_drop": "📉 Drop", "product_launch": "🚀 Launch", "patent_filing": "📄 Patent",
}


def _called(c: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c], other)


def digest(persons: DataFrame, signals: DataFrame, key: str, order: str, rank: Sequence[Column], top: int, badges: int = 5) -> DataFrame:
    """The digest as ``part, ord, line``: totals (0), a section for each of the first ``top`` persons (1), one table line for each other (2), and the sources with their counts (3).

    A section has the score with its bar, the action, badges of the first signals with what they say (120 characters), three strengths and two risks. ``persons`` need ``name, score, action, strengths, risks``.
    """
    held = persons.join(first_signals(signals, key, order, badges), key, "left")
    ranked = numbered(held, rank, "ord")
    full = F.round(F.col("score") / 10).cast("int")
    action = _called(F.col("action"), ACTIONS, F.lit("⚪ UNKNOWN"))
    badge = lambda s: _called(s["signal_type"], BADGES, F.concat(F.lit("• "), s["signal_type"]))
    listed = lambda name, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"**{name}:** "), F.array_join(F.slice(c, 1, n), " · ")))
    head = F.concat(F.lit("### "), "ord", F.lit(". "), "name", F.lit("\n**Score:** `"), F.round("score").cast("int"), F.lit("/100` `"), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full), F.lit("` "), action)
    said = F.array_join(F.transform("signals", lambda s: F.concat(F.lit("- "), badge(s), F.lit(": "), F.substring(s["description"], 1, 120))), "\n")
    section = F.concat_ws("\n", head, listed("Strengths", "strengths", 3), listed("Risks", "risks", 2), said)
    first = F.coalesce(F.substring(F.get("signals", F.lit(0))["description"], 1, 60), F.lit(""))
    line = F.concat(F.lit("| "), "name", F.lit(" | "), F.round("score").cast("int"), F.lit(" | "), action, F.lit(" | "), first, F.lit("... |"))
    rows = ranked.select(F.when(F.col("ord") <= top, 1).otherwise(2).alias("part"), "ord", F.when(F.col("ord") <= top, section).otherwise(line).alias("line"))
    counts = numbered(signals.groupBy("source").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("source")], "ord")
    sources = counts.select(F.lit(3).alias("part"), "ord", F.concat(F.lit("| "), "source", F.lit(" | "), "n", F.lit(" |")).alias("line"))
    totals = signals.agg(F.count(F.lit(1)).alias("s")).crossJoin(persons.agg(F.count(F.lit(1)).alias("p")))  # one row each
    return totals.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("**"), "s", F.lit(" signals** · **"), "p", F.lit(" founders scored**")).alias("line")).unionByName(rows).unionByName(sources)


def replace_slice(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions of ``by`` that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def flat_export(rows: DataFrame, labels: dict[str, str], stage: str, columns: Sequence[tuple[str, str, int | None]]) -> DataFrame:
    """Display columns of pipeline rows: stage labels, texts cut to their lengths."""
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col(stage)], F.col(stage))
    cut = lambda c, n: text_of(F.substring(F.col(c).cast("string"), 1, n)) if n else F.col(c)
    return rows.withColumn(stage, named).select(*(cut(c, n).alias(shown) for shown, c, n in columns))


def dossiers(persons: DataFrame, boxes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A dossier text for each entity and whether its box, by case-folded name, is updated or created."""
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields))
    have = boxes.groupBy(F.lower("box").alias("_box")).agg(F.min("box_id").alias("box_id"))
    met = persons.withColumn("dossier", text).join(have, F.lower(key) == F.col("_box"), "left").drop("_box")
    return met.withColumn("decision", F.when(F.col("box_id").isNull(), "create").otherwise("update"))


def run_history(events: DataFrame, run: str, order: str) -> DataFrame:
    """The last state of each run; one with an error text has failed."""
    last = events.groupBy(run).agg(*(F.max_by(c, order).alias(c) for c in events.columns if c not in (run,)))
    return last.withColumn("status", F.when(text_of(F.col("error")) != "", "failed").otherwise("completed"))
