"""Connected components of a link table, as a loop of joins over shrinking tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.tables import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows those pointers to
    their roots, and replaces each link by the link between roots. At least half of
    the nodes of every unfinished component vanish per round, whatever its shape.
    Aggregates combine before they shuffle and joins read written tables, so a hub
    with any number of links is split by adaptive skew handling. Links with a null
    end and loops are ignored; no links give an empty table.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = materialise(links.distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            up = root.select(F.col("node").alias("root"), F.col("root").alias("next"))
            root = materialise(root.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            if root.where("moved").isEmpty():
                break
        root = root.select("node", "root")
        rounds.append(root)
        links = (
            links.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        )
        links = materialise(links.distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(found: DataFrame, later: DataFrame) -> DataFrame:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return materialise(reduce(follow, rounds).select("node", F.col("root").alias("component")))
