"""Aggregates over signals, persons, articles and pipeline rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import text_of


def count_by(df: DataFrame, by: str, out: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), by)


def dashboard(signals: DataFrame, as_of: str, ts: str, types: Sequence[str]) -> DataFrame:
    """Counts in the last 1, 7 and 30 days, and of the given types, in one pass."""
    since = lambda d: F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(d))
    return signals.agg(*(F.count_if(since(d)).alias(f"last_{d}d") for d in (1, 7, 30)), F.count_if(F.col("signal_type").isin(*types)).alias("of_types"), F.count(F.lit(1)).alias("total"))


def distinct_persons(signals: DataFrame, person: str, exact: bool = True) -> DataFrame:
    some = signals.where(F.trim(text_of(F.col(person))) != "")
    return some.agg((F.count_distinct(person) if exact else F.approx_count_distinct(person)).alias("n_persons"))


def heat_map(labels: Sequence[str], matches: DataFrame, doc: str) -> DataFrame:
    """Documents per label with labels of none kept: above 5 bullish, above 1 neutral, else quiet."""
    spark = matches.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "label string")
    n = matches.groupBy("label").agg(F.count_distinct(doc).alias("n"))
    out = every.join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("sentiment", F.when(F.col("n") > 5, "bullish").when(F.col("n") > 1, "neutral").otherwise("quiet"))


def theme_words(query: str, longer: int = 4, most: int = 6) -> list[str]:
    """A theme's keywords: the first words of its query with more than so many letters."""
    return [w for w in query.lower().split() if len(w) > longer][:most]


def per_person(signals: DataFrame, key: Column) -> DataFrame:
    """Signals grouped by person: best score, first attributes, counts, sources and types in order."""
    return signals.groupBy(key.alias("person")).agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.max("score").alias("best_score"),
        F.min_by("signal_type", "id").alias("first_type"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("signal_type")), ",").alias("types"),
    )


def kanban(stages: Sequence[str], rows: DataFrame, stage: str, card: str, most: int = 5) -> DataFrame:
    """Every stage with its number of rows and its first cards, stages without rows too."""
    from tidemark.operators.ranking import top_per_group

    every = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(stages)], f"{stage} string, ord int")
    n = rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))
    cards = top_per_group(rows.select(stage, card), [stage], [F.col(card)], most)
    cards = cards.groupBy(stage).agg(F.array_join(F.array_sort(F.collect_list(card)), ",").alias("cards"))
    return every.join(n, stage, "left").join(cards, stage, "left").select("ord", stage, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cards", F.lit("")).alias("cards"))


def run_summary(persons: DataFrame, score: str, action: str, name: str) -> DataFrame:
    counts = persons.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(action) == "investigate").alias("investigate"),
        F.count_if(F.col(action) == "watchlist").alias("watchlist"),
        F.max_by(name, F.struct(F.col(score), F.col(name))).alias("top_lead"),
    )
    return counts.withColumn("summary", F.format_string("%d profiles reviewed: %d to investigate, %d on the watchlist. Top lead: %s.", "n", "investigate", "watchlist", "top_lead"))


def dedupe_dimension(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """Of each name the row with the smallest id."""
    keep = df.groupBy(name).agg(F.min(row_id).alias(row_id))
    return df.join(keep, [name, row_id], "left_semi")
