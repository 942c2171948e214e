"""Arrays of counts and bits filled by all tasks: map side in numpy, summed by part in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Slots of one chunk of counts, and of one block of bits; each is a row of the shuffle.
CHUNK, BLOCK = 1024, 1 << 17
SCHEMA = "chunk int, counts binary"
#: Hashes a task turns into slots at once.
FLUSH = 1 << 18
_of_width = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def chunks(counts: np.ndarray) -> pd.DataFrame:
    """Rows of SCHEMA for the chunks of ``counts`` (uint32) that hold anything, each in one, two or four bytes a count."""
    table = counts.reshape(-1, CHUNK)
    most = table.max(axis=1)
    used = np.flatnonzero(most)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    return pd.DataFrame({"chunk": used.astype(np.int32), "counts": [table[i].astype(_of_width[int(width[i])]).tobytes() for i in used]})


def gather(rows: DataFrame, slots: int) -> np.ndarray:
    """The sums over all tasks, as one array of ``slots`` uint32 at the driver.

    Its size is the parameter ``slots``, whatever the input. Each task of the shuffle
    streams the chunks dealt to it and holds one running sum for each.
    """
    most = 2**32 - 1

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch["chunk"], batch["counts"], strict=True):
                part = np.frombuffer(raw, _of_width[len(raw) // CHUNK]).astype(np.uint64)
                sums[chunk] = np.minimum(sums[chunk] + part, most) if chunk in sums else part
        yield pd.DataFrame({"chunk": np.array(list(sums), np.int32), "counts": [x.astype("<u4").tobytes() for x in sums.values()]})

    out = np.zeros((slots // CHUNK, CHUNK), np.uint32)
    for row in rows.repartition("chunk").mapInPandas(total, SCHEMA).toLocalIterator():
        out[row.chunk] = np.frombuffer(row.counts, "<u4")
    return out.reshape(-1)


def bits(hashes: DataFrame, slots: int, probes: Callable[[np.ndarray], np.ndarray], least: int) -> np.ndarray:
    """``slots`` bits, packed: which slots at least ``least`` (1 or 2) of the values in the one long column of ``hashes`` probe.

    ``probes`` gives each value's slots, one row for each probe; a value counts once in a slot. Tasks send
    only slot numbers, each ``least`` times at most for FLUSH values, and the shuffle's tasks send
    packed bits, so the driver holds ``slots / 8`` bytes.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch.iloc[:, 0].to_numpy()
            for low in range(0, len(values), FLUSH):
                at = np.sort(probes(values[low : low + FLUSH]), axis=0)
                at = np.sort(at[np.vstack([np.ones((1, at.shape[1]), bool), at[1:] != at[:-1]])])
                at = at[np.concatenate([np.ones(min(least, len(at)), bool), at[least:] != at[:-least]])]
                block, first = np.unique(at // BLOCK, return_index=True)
                yield pd.DataFrame({"chunk": block.astype(np.int32), "counts": [(x % BLOCK).astype("<u4").tobytes() for x in np.split(at, first[1:])][: len(block)]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch["chunk"], batch["counts"], strict=True):
                mine = sums.setdefault(chunk, np.zeros(BLOCK, np.uint8))
                at, times = np.unique(np.frombuffer(raw, "<u4"), return_counts=True)
                mine[at] = np.minimum(least, mine[at] + times)
        yield pd.DataFrame({"chunk": np.array(list(sums), np.int32), "counts": [np.packbits(x >= least).tobytes() for x in sums.values()]})

    out = np.zeros((-(-slots // BLOCK), BLOCK // 8), np.uint8)
    for row in hashes.mapInPandas(send, SCHEMA).repartition("chunk").mapInPandas(total, SCHEMA).toLocalIterator():
        out[row.chunk] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(-1)


def held(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
