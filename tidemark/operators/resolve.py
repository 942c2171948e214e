"""Entity resolution: records that share identity keys become one entity, whatever the chain between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import clean_name, identity_keys, text_of
from tidemark.operators.components import connected_components
from tidemark.tables import materialise


def clusters(records: DataFrame, record_id: str, keys: Column) -> DataFrame:
    """``records`` with ``cluster``, the smallest id of those linked through any shared keys.

    Each key links its records to the first one that has it, so a common key costs as many links as
    it has records. The closure is full: a record that bridges two groups joins them.
    """
    flat = records.select(F.col(record_id).alias("a"), F.explode(keys).alias("key"))
    head = flat.groupBy("key").agg(F.min("a").alias("b"))
    found = connected_components(flat.join(head, "key").select("a", "b"))
    out = records.join(found.withColumnRenamed("node", record_id), record_id, "left")
    return out.withColumn("cluster", F.coalesce("component", record_id)).drop("component")


def folded(records: DataFrame, order: Column, longest: Sequence[str] = (), first: Sequence[str] = (), most: Sequence[str] = (), any_: Sequence[str] = ()) -> DataFrame:
    """One row per cluster: longest text (the earlier on ties), first non-blank, maximum, or."""
    seen = records.withColumn("_ord", order)
    blank = lambda c: F.trim(text_of(F.col(c))) == ""
    return seen.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_records"),
        *(text_of(F.max_by(F.trim(F.col(c)), F.struct(F.length(F.trim(F.col(c))), -F.col("_ord")))).alias(c) for c in longest),
        *(text_of(F.min_by(F.when(~blank(c), F.col(c)), F.when(~blank(c), F.col("_ord")))).alias(c) for c in first),
        *(F.max(c).alias(c) for c in most),
        *(F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in any_),
    )


def evidence(signals: DataFrame, fingerprint: Column, order: str) -> DataFrame:
    """The signals of each cluster without repeats of a fingerprint, the first kept."""
    place = Window.partitionBy("cluster", "fingerprint").orderBy(order)
    return signals.withColumn("fingerprint", fingerprint).withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def light_dedupe(records: DataFrame, name: Column, headline: Column, order: str, most: int = 50) -> DataFrame:
    """Keep the first of each name (30 characters), or for unknown names of each headline (60); named ones first."""
    unknown = F.lower(text_of(name)).isin("", "unknown")
    key = F.when(unknown, F.concat(F.lit("h:"), F.substring(F.lower(text_of(headline)), 1, 60))).otherwise(F.concat(F.lit("n:"), F.substring(F.lower(name), 1, 30)))
    keyed = records.withColumn("_key", key).withColumn("_unknown", unknown)
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_n = 1")
    return first.orderBy("_unknown", order).limit(most).drop("_n", "_key", "_unknown")


def hygiene(records: DataFrame, record_id: str, name: str, profile: str, handle: str, repo: str, fingerprint: Column, keep: Column) -> DataFrame:
    """Clean, cluster, fold, unite evidence, drop: one row per entity, ``cluster, n_records, n_evidence`` and its name, profile, handle and repo.

    Names are cleaned before keys are made of them; the longest name and the first of each address stay, repeats of a fingerprint
    count once, and entities that ``keep`` (over the row returned) rejects go, as do those without a name. Clean names and keys are written
    once, since clusters read their records several times.
    """
    cleaned = records.withColumn(name, clean_name(F.col(name)))
    keyed = materialise(cleaned.withColumn("_keys", identity_keys(*(F.col(c) for c in (profile, handle, repo, name)))))
    held = materialise(clusters(keyed, record_id, F.col("_keys")).drop("_keys"))
    people = folded(held, F.col(record_id), longest=[name], first=[profile, handle, repo])
    united = held.select("cluster", fingerprint.alias("_f")).distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n_evidence"))
    return people.join(united, "cluster").where((F.col(name) != "") & keep)
