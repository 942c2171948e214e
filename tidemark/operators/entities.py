"""Entity resolution over runs: new records meet the entities that are held, and only what they touch is looked at again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.components import connected_components
from tidemark.streaming.kept import Kept
from tidemark.tables import materialise


@dataclass(frozen=True)
class Entities:
    """Three kept tables under ``path``: ``key, entity`` of identity keys, ``id, entity`` of records, and ``entity, into`` of retired entities.

    An entity is named by the id of one of its records, for good: when records join several, the one of smallest name goes on, the others are retired, each with a
    row that says what it became part of. Keys and records of a retired entity are not rewritten; readers follow its row, which always names an entity that lives.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _table(self, name: str, key: str, schema: str) -> Kept:
        return Kept(self.spark, f"{self.path}/{name}", key, self.spark.createDataFrame([], schema).schema, self.buckets)

    @property
    def keys(self) -> Kept:
        return self._table("keys", "key", "key string, entity long")

    @property
    def records(self) -> Kept:
        return self._table("records", "id", "id long, entity long")

    @property
    def retired(self) -> Kept:
        return self._table("retired", "entity", "entity long, into long")

    def _living(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``entity`` followed to the one that lives."""
        found = rows.join(self.retired.read(), "entity", "left")
        return found.withColumn("entity", F.coalesce("into", "entity")).drop("into")

    def resolved(self) -> DataFrame:
        """``id, entity`` of every record so far."""
        return self._living(self.records.read()).select("id", "entity")

    def add(self, news: DataFrame, record_id: str, keys: Column) -> DataFrame:
        """Resolve ``news`` (ids that are not held yet, none null) and keep the result; returns ``entity, into`` of those retired by it.

        Joins and components run over the new records, their keys, and the entities these keys lead to; each kept table rewrites only the buckets of
        keys, records and entities that changed. A key that many records share costs one link for each.
        """
        flat = materialise(news.select(F.col(record_id).cast("long").alias("id"), F.explode_outer(keys).alias("key")))
        asked = flat.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
        held = materialise(self._living(self.keys.read().join(asked.select("key"), "key", "left_semi")).select("key", "entity"))
        head = asked.join(held, "key", "left").select("key", F.coalesce("entity", "first").alias("head"))
        found = connected_components(flat.join(head, "key").select(F.col("id").alias("a"), F.col("head").alias("b")))
        alone = flat.select(F.col("id").alias("node")).unionByName(held.select(F.col("entity").alias("node"))).distinct().join(found, "node", "left_anti")
        found = found.unionByName(alone.withColumn("component", F.col("node")))
        old = held.select(F.col("entity").alias("node")).distinct().withColumn("old", F.lit(True))
        marked = materialise(found.join(old, "node", "left"))
        name = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("old"), F.col("node"))), F.min("node")).alias("entity"))
        named = materialise(marked.join(name, "component").select("node", "old", "entity"))
        gone = materialise(named.where("old and node <> entity").select(F.col("node").alias("entity"), F.col("entity").alias("into")))
        members = named.select(F.col("node").alias("id"), "entity").join(flat.select("id").distinct(), "id", "left_semi")
        fresh = flat.where("key is not null").join(held.select("key"), "key", "left_anti").join(members, "id").groupBy("key").agg(F.min("entity").alias("entity"))
        latest = lambda key: lambda had, new: had.join(new, key, "left_anti").unionByName(new)
        moved = self.retired.read().alias("r").join(gone.select(F.col("entity").alias("was"), F.col("into").alias("now")), F.col("into") == F.col("was"))
        forward = materialise(gone.unionByName(moved.select("entity", F.col("now").alias("into"))))
        self.keys.merge(fresh.select("key", "entity"), latest("key"))
        self.retired.merge(forward, latest("entity"))
        self.records.merge(members.select("id", "entity"), latest("id"))
        return gone
