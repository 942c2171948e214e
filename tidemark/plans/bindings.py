"""The entities of the engine as views over the driver's tables, for Spark and, side by side, for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.words import STAGES
from tidemark.tables import table

AS_OF = "2024-01-31 00:00:00"
TYPES = ("purchase", "signup", "error", "view", "click")
#: Theme words and gazetteers from the tables' own vocabulary.
THEMES = (("metal", ("ring", "bolt", "anvil")), ("tool", ("widget", "gear")), ("colour", ("red", "blue")), ("size", ("small", "large")), ("none", ("zzz",)))
TONGUES = (("english", (" the ", " that ", " with ")), ("french", (" les ", " une ", " des ")), ("german", (" der ", " und ", " ein ")), ("spanish", (" que ", " los ", " una ")))


def contains_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


class Views:
    """Lazily built views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def signals(self) -> DataFrame:
        """``id, source, signal_type, description, url, detected_at, person_name, person_linkedin, score, raw_data``."""
        user = F.col("user_id").cast("string")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("src"), F.pmod("user_id", F.lit(5)).cast("string")).alias("source"),
            F.col("event_type").alias("signal_type"),
            F.concat("event_type", F.lit(" by user "), user).alias("description"),
            F.concat(F.lit("https://ex.com/u/"), user, F.lit("/"), "event_type").alias("url"),
            F.col("ts").alias("detected_at"),
            F.concat(F.lit("User "), user).alias("person_name"),
            F.when(F.pmod("user_id", F.lit(3)) == 0, F.concat(F.lit("https://www.linkedin.com/in/u"), user)).otherwise("").alias("person_linkedin"),
            F.col("value").alias("score"),
            F.col("props").alias("raw_data"),
        )

    @cached_property
    def outreach(self) -> DataFrame:
        """``oid, signal_id, o_name, o_linkedin, stage, lead_score, created_at``; a signal id of 0 is none."""
        who = F.col("o_custkey").cast("string")
        stage = F.element_at(F.array(*map(F.lit, STAGES)), F.substring("o_orderpriority", 1, 1).cast("int"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("oid"),
            F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(0).alias("signal_id"),
            F.concat(F.lit("User "), who).alias("o_name"),
            F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("https://www.linkedin.com/in/u"), who)).otherwise("").alias("o_linkedin"),
            stage.alias("stage"),
            F.col("o_totalprice").alias("lead_score"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        """``pid, name, sector, location, region, p_score``."""
        c = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return c.select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("sector"), F.col("n_name").alias("location"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("p_score"))

    @cached_property
    def articles(self) -> DataFrame:
        """``ord, title, summary, source, lang, url``: a text's first 80 characters are its title, all the rest its summary."""
        text = F.coalesce("text", F.lit(""))
        return self.raw("documents").select(
            F.col("doc_id").alias("ord"), F.substring(text, 1, 80).alias("title"), F.expr("substring(coalesce(text, ''), 81)").alias("summary"), "source", "lang",
            F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.concat(F.lit("https://ex.com/"), F.md5(text))).alias("url"),
        )

    @cached_property
    def themes(self) -> DataFrame:
        """``part, text, brand``: short texts for dictionary matches."""
        return self.raw("part").select(F.col("p_partkey").alias("part"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))

    @cached_property
    def observations(self) -> DataFrame:
        """``profile, ord, headline``: turns of a conversation as sightings of one profile."""
        return self.raw("conversations").select(F.col("conv_id").alias("profile"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("headline"), "role")


_STAGE = "[" + ", ".join(f"'{s}'" for s in STAGES) + "][substr(o_orderpriority, 1, 1)::INT]"
PRELUDE = f"""WITH RECURSIVE signals AS (
  SELECT event_id AS id, 'src' || (user_id % 5) AS source, event_type AS signal_type, event_type || ' by user ' || user_id AS description,
    'https://ex.com/u/' || user_id || '/' || event_type AS url, ts AS detected_at, 'User ' || user_id AS person_name,
    CASE WHEN user_id % 3 = 0 THEN 'https://www.linkedin.com/in/u' || user_id ELSE '' END AS person_linkedin, value AS score, props AS raw_data FROM events),
outreach AS (
  SELECT o_orderkey AS oid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS signal_id, 'User ' || o_custkey AS o_name,
    CASE WHEN o_custkey % 3 = 0 THEN 'https://www.linkedin.com/in/u' || o_custkey ELSE '' END AS o_linkedin, {_STAGE} AS stage,
    o_totalprice AS lead_score, o_orderdate AS created_at FROM orders),
persons AS (
  SELECT c_custkey AS pid, c_name AS name, lower(c_mktsegment) AS sector, n_name AS location, r_name AS region, c_acctbal AS p_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
articles AS (
  SELECT doc_id AS ord, substr(coalesce(text, ''), 1, 80) AS title, substr(coalesce(text, ''), 81) AS summary, source, lang,
    CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'https://ex.com/' || md5(coalesce(text, '')) END AS url FROM documents),
themes AS (SELECT p_partkey AS part, p_name || ' ' || p_type AS text, p_brand AS brand, p_retailprice AS price FROM part),
observations AS (SELECT conv_id AS profile, turn AS ord, coalesce(text, '') AS headline, role FROM conversations)
"""
