"""Embedding near-dedup: p-stable hashing of normalised vectors, then exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.components import connected_components
from tidemark.tables import materialise


@dataclass(frozen=True)
class Lsh:
    """Parameters. Two unit vectors at cosine 0.98 lie 0.2 apart: with ``width`` 1.6 one projection
    keeps them together with probability 0.90, ``projections`` of them with 0.25, and one of ``tables`` at least with 0.9998."""

    cosine: float = 0.98
    tables: int = 30
    projections: int = 13
    width: float = 1.6
    block: int = 512
    seed: int = 17
    whole: int = 4096


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of rows of one length in double precision, and which rows have one (the rest: zero or not finite)."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        return vectors / np.where(ok, norm, 1)[:, None], ok


def _hashed(distinct: DataFrame, lsh: Lsh) -> DataFrame:
    """``distinct`` with ``keys``, for each usable vector its bucket in every table, and ``row``, a number of its own."""
    kind = distinct.schema["v"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, same in batch.groupby(batch["v"].map(len)):
                if not size:
                    continue
                unit, ok = _unit(np.stack(same["v"].to_numpy()).astype(np.float64))
                if not ok.any():
                    continue
                same, unit = same[ok], unit[ok]
                if size not in made:
                    rng = np.random.default_rng([lsh.seed, size])
                    made[size] = rng.normal(size=(size, lsh.tables * lsh.projections)), rng.uniform(0, lsh.width, lsh.tables * lsh.projections)
                a, b = made[size]
                cell = np.floor((unit @ a + b) / lsh.width).astype(np.int64).reshape(len(unit), lsh.tables, lsh.projections).astype(np.uint64)
                key = np.full(cell.shape[:2], np.uint64(size))
                for k in range(lsh.projections):
                    key = (key ^ cell[:, :, k]) * np.uint64(0x100000001B3)
                    key ^= key >> np.uint64(29)
                yield same.assign(keys=list(key.view(np.int64)))[["label", "k1", "k2", "v", "times", "keys"]]

    made = distinct.mapInPandas(read, f"label long, k1 long, k2 long, v {kind}, times long, keys array<long>")
    return materialise(made.withColumn("row", F.monotonically_increasing_id()))


def _compare(rows: DataFrame, lsh: Lsh) -> DataFrame:
    """Compare the units dealt to each task, in order of the unit: ``row, links, low`` for each row with a link.

    A unit holds one block or two of a bucket, so a task holds about ``2 * block`` vectors.
    A pair is counted in its first common table alone, as often as the other vector occurs. ``low`` is the smallest row reachable by links within the unit.
    """

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rest[["t", "key", "label", "i", "j"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cut[:-1]], cut, strict=False):
                yield rest.iloc[s:e]
            if len(cut):
                rest = rest.iloc[cut[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield rest

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for unit in units(batches):
            if len(unit) < 2 or unit["v"].map(len).nunique() > 1:  # hashes of two lengths that happen to be equal
                continue
            vectors, keys = _unit(np.stack(unit["v"].to_numpy()).astype(np.float64))[0], np.stack(unit["keys"].to_numpy())
            rows, times, part, t = unit["row"].to_numpy(), unit["times"].to_numpy(), unit["part"].to_numpy(), int(unit["t"].iloc[0])
            i, j = int(unit["i"].iloc[0]), int(unit["j"].iloc[0])
            linked = vectors @ vectors.T >= lsh.cosine
            np.fill_diagonal(linked, False)
            if i != j:  # within a block they meet in the unit (i, i)
                linked &= part[:, None] != part[None, :]
            if not linked.any():
                continue
            fresh = linked.copy()
            for earlier in range(t):
                fresh &= keys[:, None, earlier] != keys[None, :, earlier]
            low = rows.copy()
            while True:
                new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (new == low).all():
                    break
                low = new
            hit = linked.any(axis=1)
            out.append(pd.DataFrame({"row": rows[hit], "links": (fresh @ times)[hit], "low": low[hit]}))
            if len(out) >= 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return rows.mapInPandas(work, "row long, links long, low long")


def _missed(hashed: DataFrame, lsh: Lsh) -> DataFrame:
    """The links whose vectors share no bucket, in both directions: ``row, links, low`` as ``_compare`` gives them, one row for each.

    All pairs of a label are compared, quadratic in the label by nature: blocks of about ``whole`` vectors, every two a unit of work of its own, which
    a task multiplies in strips. Only missed links leave it, one in some thousands of all.
    """
    same = ["label", "dim"]
    dealt = hashed.withColumn("dim", F.size("v"))
    sizes = dealt.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / lsh.whole).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, same).withColumn("part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*same, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "times", "v", "keys")

    def work(unit: pd.DataFrame) -> pd.DataFrame:
        vectors, keys = _unit(np.stack(unit["v"].to_numpy()).astype(np.float64))[0], np.stack(unit["keys"].to_numpy())
        rows, times, part = unit["row"].to_numpy(), unit["times"].to_numpy(), unit["part"].to_numpy()
        i, j = int(unit["i"].iloc[0]), int(unit["j"].iloc[0])
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        out = [pd.DataFrame({"row": rows[:0], "links": times[:0], "low": rows[:0]})]
        for s in range(0, len(left), 256):
            a, b = np.nonzero(vectors[left[s : s + 256]] @ vectors[right].T >= lsh.cosine)
            a, b = left[s + a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 65536):
                x, y = a[at : at + 65536], b[at : at + 65536]
                new = (keys[x] != keys[y]).all(axis=1)
                x, y = x[new], y[new]
                low = np.minimum(rows[x], rows[y])
                out += [pd.DataFrame({"row": rows[p], "links": times[q], "low": low}) for p, q in ((x, y), (y, x))]
        return pd.concat(out)

    return dealt.groupBy(*same, "i", "j").applyInPandas(work, "row long, links long, low long")


def near_vectors(vectors: DataFrame, lsh: Lsh = Lsh(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label (not null) and one length link when their cosine in double precision is ``cosine``
    or more; a vector that is null, zero or holds null or non-finite components links with nothing, as does one with a null id
    (no component, kept). Rows that share an id are vectors of their own; ``component_id`` is the smallest id among the vectors
    reachable by links. An empty table gives an empty one; other columns are not read.

    Equal vectors of a label are first brought together, in a count that combines before its shuffle, and stand as one with
    their number: links among and to them follow by arithmetic. Buckets of one are dropped; larger ones than ``block`` are dealt in blocks, and every pair of
    blocks is a unit of work of its own. Pairs never leave their task: what shuffles is a count and a smallest reachable row.
    An exact check follows: the pairs of a label that share no bucket are compared too, so that no link is missing.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    keyed = slim.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v")})  # 128 bits name a vector
    same = ["label", "k1", "k2"]
    distinct = keyed.where(sound).groupBy(*same).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    hashed = _hashed(distinct, lsh)
    cells = hashed.select("row", "label", F.posexplode("keys").alias("t", "key"))
    sizes = materialise(cells.groupBy("t", "key", "label").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    met = materialise(cells.join(sizes, ["t", "key", "label"])).join(hashed.select("row", "times", "v", "keys"), "row")
    blocks = F.ceil(F.col("rows") / lsh.block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "key", "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "times", "v", "keys")
    unit = ["t", "key", "label", "i", "j"]
    hit = materialise(_compare(met.repartition(*unit).sortWithinPartitions(*unit), lsh))
    found = hit.unionByName(materialise(_missed(hashed, lsh)))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("row").alias("a"), F.col("low").alias("b")))
    placed = hashed.select("row", "times", *same).join(links, "row", "left").join(components.withColumnRenamed("node", "row"), "row", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
    placed = materialise(placed.select(*same, n_links, F.coalesce("component", "row").alias("c")).where("n_links > 0"))
    rows = keyed.withColumn("sound", sound).select("id", F.when(F.col("sound"), F.col("label")).alias("label"), "k1", "k2").join(placed, same, "left")
    rows = materialise(rows)
    low = materialise(rows.where("c is not null").groupBy("c").agg(F.min("id").alias("component")))
    component = F.coalesce("component", "id")
    return rows.join(low, "c", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )
