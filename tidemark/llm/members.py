"""Telling rows that cannot be in a set of ids apart, without moving them; and names that clash with no column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import counters
from tidemark.llm.hashing import mix


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` (in any case of letters) bears it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by quoted name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def slots_for(rows: int, per_row: int, most: int) -> int:
    """``per_row`` slots for each row or up to twice as many: a power of two, at least one block and ``most`` at most."""
    return min(most, max(counters.BLOCK, 1 << (per_row * max(1, rows) - 1).bit_length()))


class IdFilter:
    """A test, for use in tasks, that is false only for longs not among the ids in the first column of ``ids``.

    The ids are hashed into a bitmap of 8 to 16 bits for each, which is broadcast; beyond 32 million ids (32 MB, a
    proven bound) each has fewer, so that more pass. What follows must be exact by itself.
    """

    def __init__(self, ids: DataFrame, most: int = 1 << 28):
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null")
        self.slots = slots = slots_for(ids.count(), 8, most)
        self.sent = ids.sparkSession.sparkContext.broadcast(counters.bits(ids, slots, lambda x: _slots_of(x, slots)[None, :], 1))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return counters.held(self.sent.value, _slots_of(values, self.slots))


def _slots_of(values: np.ndarray, slots: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) % np.uint64(slots)).astype(np.int64)


def maybe_members(rows: DataFrame, id_col: str, test: IdFilter, out: str = "maybe") -> DataFrame:
    """``rows`` with ``out``: false only where the long ``id_col`` fails ``test``. A null id is no member."""

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy()))

    return rows.withColumn(out, F.col(id_col).isNotNull() & held(F.coalesce(F.col(id_col).cast("long"), F.lit(0))))


def survivors(docs: DataFrame, id_col: str, ids: DataFrame, test: IdFilter) -> DataFrame:
    """Of the rows of ``docs`` that pass ``test`` (made of ``ids``) those whose id is not in the first column of ``ids``."""
    maybe, gone = unused(docs, "maybe", "gone")
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(gone)).distinct()
    some = maybe_members(docs, id_col, test, maybe).where(F.col(maybe))
    return some.join(ids, some[id_col].cast("long") == ids[gone], "left_anti").select(*own(docs))


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in the first column of ``ids``, with their own columns alone; only rows that may be hit shuffle."""
    test = IdFilter(ids)
    (maybe,) = unused(docs, "maybe")
    sure = maybe_members(docs, id_col, test, maybe).where(~F.col(maybe)).select(*own(docs))
    return sure.unionByName(survivors(docs, id_col, ids, test))
