"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated hashes shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import counters
from tidemark.llm.hashing import mix
from tidemark.llm.members import IdFilter, maybe_members, own, slots_for, unused
from tidemark.tables import materialise

PROBES = 4
#: Slots for each row; and the most slots of one filter, 16 MB as bits at the driver and in each Python worker.
PER_ROW, MOST = 8, 1 << 27
#: Rows of one range of hashes, where they are too many for one filter: 8 MB of hashes and 8 MB of filter in a task.
RANGE_ROWS = 1 << 20


def _probes(keys: np.ndarray, slots: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64))
    step = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(slots) for i in range(PROBES)]).astype(np.int64)


def _flagged(rows: DataFrame, hash_col: str, slots: int, out: str) -> DataFrame:
    """Pass one counts the hashes of ``rows`` into a filter of ``slots``; pass two looks each of them up."""
    twice = counters.bits(rows.select(hash_col), slots, lambda h: _probes(h, slots), 2)
    sent = rows.sparkSession.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(counters.held(sent.value, _probes(h.to_numpy(), slots)).all(axis=0))

    return rows.withColumn(out, repeated(F.col(hash_col)))


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct hashes of each batch and whether they come twice in it: a hash of a third of all rows leaves a task once a batch."""
    for batch in batches:
        values, times = np.unique(batch.iloc[:, 0].to_numpy(), return_counts=True)
        yield pd.DataFrame({"h": values, "n": np.minimum(times, 2).astype(np.int32)})


def _found_in_ranges(hashes: DataFrame, ranges: int, slots: int) -> DataFrame:
    """The hashes that may be repeated, in ``ranges`` partitions of the hashes with a filter of ``slots`` each, built and looked up in one task."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"h": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)}), *batches])
        values, at = np.unique(held["h"].to_numpy(np.int64), return_inverse=True)
        times = np.minimum(np.bincount(at, weights=held["n"].to_numpy(), minlength=len(values)), 2)
        counts = np.zeros(slots, np.uint8)
        for probe in _probes(values, slots):
            counts = np.minimum(counts + np.bincount(probe, weights=times, minlength=slots), 2).astype(np.uint8)
        yield pd.DataFrame({"h": values[(counts[_probes(values, slots)] >= 2).all(axis=0)]})

    return hashes.mapInPandas(_thinned, "h long, n int").repartition(ranges, "h").mapInPandas(find, "h long")


def flag_repeats(rows: DataFrame, hash_col: str, slots: int | None = None, out: str = "maybe_repeated", most: int = MOST) -> DataFrame:
    """``rows`` with ``out``: false only where no other row has the same ``hash_col`` (long, not null).

    A filter has ``slots`` at most (by default PER_ROW for each row, up to ``most``). Where the rows ask for more, their hashes alone, thinned
    before, are dealt in ranges of RANGE_ROWS rows at most; in one job each task fills and looks up the filter of its range, and the hashes it finds are
    told from the others by a bitmap of bounded size. So work stays in proportion to the rows, and the driver holds no more at any number of them. Rows do not move.
    """
    number = rows.count()
    full = slots or slots_for(number, PER_ROW, most)
    if number * PER_ROW <= 2 * full:
        return _flagged(rows, hash_col, full, out)
    share = min(RANGE_ROWS, max(1, full // PER_ROW))
    found = materialise(_found_in_ranges(rows.select(hash_col), -(-number // share), slots_for(share, PER_ROW, PER_ROW * RANGE_ROWS)))
    return maybe_members(rows, hash_col, IdFilter(found), out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the row with
    the largest id stays (``keep_id``); a null id loses to any other. Of several rows that share text and id, all
    count in ``group_size`` and all are ``kept`` (they cannot be told apart). An empty table gives an empty one, and other
    columns are not read. Only rows the filter flags shuffle, as id and hash; texts never do. The count of a group
    combines before its shuffle, and the join back splits a hot group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    marked = materialise(flag_repeats(keyed, "h", slots).drop("h"))
    some = marked.where("maybe_repeated").select("doc_id", "text_sha256")
    groups = materialise(some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    rest = marked.where("not maybe_repeated").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return some.join(groups, "text_sha256").unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns alone: one of each text (rows that share text and id leave one).

    Null texts count as empty, so one of those stays; a null id loses to any other. The same two passes; texts are read where they lie and only possibly
    repeated rows meet others.
    """
    h, maybe, sha, key = unused(docs, "h", "maybe_repeated", "sha", "key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    flagged = flag_repeats(docs.withColumn(h, F.xxhash64(text)), h, slots, maybe)
    single = flagged.where(~F.col(maybe)).select(*own(docs))
    row = F.struct(F.col(id_col).alias("i"), F.monotonically_increasing_id().alias("n"))
    some = materialise(flagged.where(F.col(maybe)).select(*own(docs), F.sha2(text, 256).alias(sha), row.alias(key)))
    last = materialise(some.groupBy(sha).agg(F.max(key).alias(key)))
    return single.unionByName(some.join(last, [sha, key], "left_semi").select(*own(docs)))
