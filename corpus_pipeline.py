"""From raw documents to sampled pieces: five stages, each over all that the one before kept.

All but the last return the columns they were given, whatever further ones there are and however they are called; each
gives an empty table for an empty one. A null text counts as empty, and rows of null id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from tidemark.llm.members import own, unused
from tidemark.llm.queries import tokenizer_file
from tidemark.tables import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; labels train, and decide nothing here.

    Empty texts are never toxic; repeated rows fare alike.
    """
    conf = toxicity.Toxicity()
    (score,) = unused(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), conf), score)
    return scored.where(F.col(score) < conf.threshold).select(*own(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id, and of rows that share it one; null loses to any id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows of null id and texts without words stay, rows that share an id fare alike."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. Null is a source; rows that share an id and source are taken together."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_pieces, ids`` for every document of the mix; copies of one document get the same ids."""
    coded = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pieces", to_pieces),
]

#: Trained and sampled stages have no SQL; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
