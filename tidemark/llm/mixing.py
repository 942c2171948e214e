"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.members import own, unused
from tidemark.tables import materialise

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters: total as a share of all words, weights dealt to sources in order, most passes over a source."""

    share: float = 1.5
    weights: tuple[int, ...] = (5, 2, 1)
    passes: int = 2
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """A number below 2**60 that puts the documents of a source in an order free of their ids."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size, target`` of every source, by filling up to a common level.

    A source's target is its weight times the level, but at most ``passes`` times its size; the
    level is where the targets add up to the total. Sources stand in code point order, null last. One
    row per source is all that meets in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(named) - 1) % len(mix.weights) + 1).cast("double")
    per = per.withColumn("weight", weight).withColumn("most", mix.passes * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (mix.share * F.sum("source_size").over(everything) - full_before) / weight_left)
    per = per.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("most") / F.col("weight"))).over(everything)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def fair_queue(sized: DataFrame, per_source: DataFrame, mix: Mix) -> DataFrame:
    """What the mix takes: ``source, pass, h, doc_id, size, finish, taken`` for each place in the queue and pass.

    ``sized`` has ``doc_id, source, size, h``. Rows of one id and source share a place and count together, before they
    shuffle. The virtual finish time is the source's words up to and with the place, over its target; its running sums
    are taken in about as many slices of the shuffle key as the square root of the rows. The queue is then sorted in one global order
    by range, and cut where the words before reach the budget: sums of whole ranges come first, and only the one range that holds
    the cut is summed row by row. No source, however large, and no sum over all rows lies in one task.
    """
    places = materialise(sized.groupBy("source", "h", "doc_id").agg(F.sum("size").alias("size")))
    n = int(max(1, places.count()) ** 0.5) + 1
    sliced = places.withColumn("slice", F.floor(F.col("h") / F.lit(float(1 << 60)) * n))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = sliced.withColumn("inside", F.sum("size").over(inside)).withColumnRenamed("source", "s").withColumnRenamed("slice", "k")
    run = run.join(sums, F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("slice"))).drop("source", "k", "slice")
    run = run.join(per_source, F.col("s").eqNullSafe(F.col("source"))).drop("source").withColumnRenamed("s", "source")
    queue = run.where("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(mix.passes - 1))))
    queue = queue.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("base") + F.col("inside")) / F.col("target"))
    columns = ["source", "pass", "h", "doc_id", "size", "finish"]
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("h"), F.col("doc_id")]
    queue = materialise(queue.select(*columns))
    queue = materialise(queue.repartitionByRange(*order).withColumn("at", F.spark_partition_id()))
    times = queue.groupBy("at").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one row for each range
    budget = F.lit(mix.share * (per_source.agg(F.sum("source_size")).first()[0] or 0))
    times = times.withColumn("upto", F.sum("words").over(upto))
    times = materialise(times.select("at", (F.col("upto") - F.col("words")).alias("start"), (F.col("upto") <= budget).alias("whole")))
    timed = queue.join(times.where(F.col("start") <= budget), "at")
    in_range = Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = timed.where("not whole").withColumn("upto", F.col("start") + F.sum("size").over(in_range)).where(F.col("upto") <= budget)
    return timed.where("whole").select(*columns).unionByName(cut.select(*columns))


def limits(taken: DataFrame) -> DataFrame:
    """The last place taken of each source, ``source, last``: in queue order all before it are taken too."""
    return taken.groupBy("source").agg(F.max(F.struct("pass", "h", "doc_id")).alias("last"))


def _planned(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, source's size, target and times under names that no column of ``docs`` bears, and those names."""
    made = unused(docs, "size", "source_size", "target", "times")
    size, source_size, target, times = made
    h, last, of = unused(docs, "h", "last", "of")
    key, doc_id, source = shuffle_key(F.col(id_col), mix.seed), F.col(id_col), F.col(source_col)
    slim = docs.select(doc_id.alias("doc_id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("h"))
    slim = materialise(slim)
    per_source = materialise(targets(slim, mix))
    ends = limits(fair_queue(slim, per_source, mix)).withColumnRenamed("source", "s")
    facts = per_source.join(ends, F.col("s").eqNullSafe(F.col("source")), "left")
    facts = materialise(facts.select(F.col("source").alias(of), F.col("source_size").alias(source_size), F.coalesce("target", F.lit(0.0)).alias(target), F.col("last").alias(last)))
    placed = docs.withColumns({size: word_count(F.col(text_col)), h: key})
    joined = placed.join(facts, source.eqNullSafe(F.col(of)), "left")
    place = lambda p: F.struct(F.lit(p).alias("pass"), F.col(h).alias("h"), doc_id.alias("doc_id"))
    taken = sum((F.coalesce(place(p) <= F.col(last), F.lit(False)).cast("int") for p in range(mix.passes)), F.lit(0))
    return joined.withColumn(times, taken).select(*own(docs), *made), made


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _times``: how often (0 to ``passes``) the mix takes each row.

    Columns of ``docs`` by one of these names are replaced. Null text has no words; null is a source of its own. Rows with one id
    and source, null ids too, share a place in the queue and are taken together. A source without words has
    target 0, and documents without words are taken as their place falls. An empty table gives an empty one. Texts do not shuffle: the limits, one row per source,
    join them where they lie. One row per source is all that is ever summed in one task.
    """
    names = ["_size", "_source_size", "_target", "_times"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    planned, made = _planned(docs, mix, id_col, text_col, source_col)
    return planned.withColumnsRenamed(dict(zip(made, names, strict=True)))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it takes it, with their own columns alone; whatever these are called."""
    planned, (_, _, _, times) = _planned(docs, mix, "doc_id", "text", "source")
    (copy,) = unused(planned, "copy")
    planned = planned.where(F.col(times) > 0)
    return planned.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*own(docs))


def queue_order(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as a list, ``finish, source, doc_id, copy, size``, in one global order by range."""
    slim = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), mix.seed).alias("h")))
    taken = fair_queue(slim, materialise(targets(slim, mix)), mix)
    return taken.select("finish", "source", "doc_id", F.col("pass").alias("copy"), "size").orderBy("finish", F.col("source").asc_nulls_last(), "copy", "doc_id")
