"""Embedding whitening: eigenvectors of a distributed covariance, refined from float32 by matrix multiplications in higher precision.

The refinement is that of Ogita and Aishima (Japan J. Indust. Appl. Math. 35, 2018, and 36, 2019).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.tables import materialise

#: Float64 holds integers below this exactly, and a sum of two such numbers (a pair) those below its square.
WHOLE = 1 << 53
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Parameters: entries are scaled by ``scale`` and floored; ``components`` at most are returned."""

    scale: int = 256
    components: int = 4


@dataclass(frozen=True)
class Fit:
    """What is learnt of all vectors of one length: their number, exact sums, falling eigenvalues and one unit eigenvector in each column."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def projection(self, most: int) -> np.ndarray:
        """Columns that whiten a centred vector: eigenvectors over roots of their eigenvalues, of those above rounding error."""
        kept = self.values[:most] > len(self.sums) * np.finfo(np.float64).eps * max(self.values[0], 0.0)
        keep = int(np.argmin(kept)) if not kept.all() else len(kept)
        return (self.vectors[:, :keep] / np.sqrt(self.values[:keep])).astype(np.float64)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One iteration for the symmetric ``a`` in its precision: better eigenvectors than ``x``, their eigenvalues, and the
    distance below which two eigenvalues cannot be told apart yet."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, over small gaps, would spoil orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = lambda m: float(np.sqrt((m * m).sum()))
    near = 2 * (norm(off) + norm(a) * norm(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ step, values, near


def _split_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, near: float) -> np.ndarray:
    """``x`` turned, within each group of eigenvalues closer than ``near``, to the eigenvectors of the group's own small matrix."""
    order = np.argsort(values)
    cuts = [0, *(np.flatnonzero(np.diff(values[order]) > near) + 1).tolist(), len(order)]
    x = x.copy()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high - low > 1:
            own = order[low:high]
            part = x[:, own]
            shifted = a @ part - part * values[own].mean()
            small = part.T @ shifted
            small = (small + small.T) / 2
            most = np.abs(small).max()
            if most > 0:
                x[:, own] = part @ np.linalg.eigh((small / most).astype(np.float64))[1].astype(a.dtype)
    return x


def eigen(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors of the symmetric ``a`` (long double), each with its largest entry positive.

    Float32 eigenvectors are corrected in double precision until they get no better, then in that of ``a``;
    whenever eigenvalues are too close to be told apart, their vectors are first turned by a solve of that group alone.
    """
    scale = np.abs(a).max() if a.size else 0
    if not scale:
        return np.zeros(len(a), a.dtype), np.eye(len(a), dtype=a.dtype)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind in (np.float64, a.dtype):
        b, x, last = a.astype(kind), x.astype(kind), np.inf
        for _ in range(rounds):
            x, values, near = refine(b, x)
            if not near < last / 2:
                break
            x, last = _split_clusters(b, x, values, near), near
    x, values, _ = refine(b, x)
    for _ in range(2):  # a last large turn within a cluster leaves its square
        x = x + x @ (np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(x))])
    return values, x * sign


def _add(hi: np.ndarray, lo: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair ``hi + lo`` plus ``x``, without rounding while whole numbers stay below 2**106."""
    s = hi + x
    b = s - hi
    return s, lo + ((hi - (s - b)) + (x - b))


def _stacked(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """The rows of each length above 0, and their vectors as whole numbers."""
    for dim, same in batch.groupby(batch["x"].map(len)):
        if dim:
            yield int(dim), same, np.stack(same["x"].to_numpy()).astype(np.int64)


def whole(vec: Column, conf: Whitening = Whitening()) -> Column:
    """Entries times ``scale``, floored, as longs (those beyond a long become the nearest one)."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * conf.scale).cast("long"))


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length the number of vectors and their exact sums; each task sends one row for each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _stacked(batch):
                safe = int(np.abs(x.astype(np.float64)).max()) * len(x) < LONG // 4
                part = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                old = seen.setdefault(dim, [0, np.zeros(dim, object)])
                seen[dim] = [old[0] + len(x), old[1] + part]
        for dim, (n, total) in seen.items():
            yield pd.DataFrame({"dim": dim, "pos": np.arange(dim), "n": n, "total": [str(v) for v in total]})

    parts = distinct.mapInPandas(add, "dim int, pos int, n long, total string")
    rows = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.dim, r.pos)):
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.total))
    return out


def _products(distinct: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each length the sum of products of vectors less their centre (whole numbers), summed by matrix row in a shuffle."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, _, x in _stacked(batch):
                d = x.astype(np.float64) - centres[dim]
                rows = max(1, int(WHOLE / max(1.0, float(np.abs(d).max()) ** 2)))  # so many products add up exactly
                hi, lo = held.get(dim, (np.zeros((dim, dim)), np.zeros((dim, dim))))
                for k in range(0, len(d), rows):
                    hi, lo = _add(hi, lo, d[k : k + rows].T @ d[k : k + rows])
                held[dim] = hi, lo
        for dim, (hi, lo) in held.items():
            yield pd.DataFrame({"dim": dim, "pos": np.arange(dim), "hi": [v.tobytes() for v in hi], "lo": [v.tobytes() for v in lo]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, pos, *pair in batch[["dim", "pos", "hi", "lo"]].itertuples(index=False):
                hi, lo = sums.get((dim, pos), (np.zeros(dim), np.zeros(dim)))
                for part in pair:
                    hi, lo = _add(hi, lo, np.frombuffer(part))
                sums[dim, pos] = hi, lo
        yield pd.DataFrame([(d, p, hi.tobytes(), lo.tobytes()) for (d, p), (hi, lo) in sums.items()], columns=["dim", "pos", "hi", "lo"])

    schema = "dim int, pos int, hi binary, lo binary"
    out = {dim: np.zeros((dim, dim), np.longdouble) for dim in centres}
    for r in distinct.mapInPandas(multiply, schema).repartition("dim", "pos").mapInPandas(total, schema).toLocalIterator():
        out[r.dim][r.pos] = np.frombuffer(r.hi).astype(np.longdouble) + np.frombuffer(r.lo)
    return out


def fit(distinct: DataFrame) -> dict[int, Fit]:
    """Fits, by length, over the rows of ``distinct`` (``x array<long>``). The driver holds one matrix for each length of vectors, whatever the rows.

    Vectors are centred at the whole numbers nearest their means before they are multiplied, which keeps all sums
    exact (in any order) below 2**106; what the means have beyond those numbers is taken off the covariance after.
    """
    sums = _sums(distinct)
    near = {dim: [(2 * s + n) // (2 * n) for s in total] for dim, (n, total) in sums.items()}
    products = _products(distinct, {dim: np.array(c, np.float64) for dim, c in near.items()})
    fits = {}
    for dim, (n, total) in sums.items():
        rest = np.array([s - n * c for s, c in zip(total, near[dim], strict=True)], np.longdouble) / n
        covariance = products[dim] / n - np.outer(rest, rest)
        values, vectors = eigen((covariance + covariance.T) / 2)
        fits[dim] = Fit(n, tuple(total), np.array(near[dim], np.float64), rest.astype(np.float64), values, vectors, float(np.trace(covariance)))
    return fits


def _centred(x: np.ndarray, f: Fit) -> np.ndarray:
    return (x - f.centre) - f.rest


def _identity_errors(distinct: DataFrame, fits: dict[int, Fit], most: int) -> dict[int, float]:
    """The largest entry by which the covariance of the whitened vectors misses the identity; a task sends its own mean and centred products."""
    project = {dim: f.projection(most) for dim, f in fits.items()}

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, _, x in _stacked(batch):
                w = _centred(x, fits[dim]) @ project[dim]
                mean = w.mean(axis=0)
                yield pd.DataFrame([(dim, len(w), mean, ((w - mean).T @ (w - mean)).ravel())], columns=["dim", "n", "mean", "products"])

    entry = distinct.mapInPandas(moments, "dim int, n long, mean array<double>, products array<double>")
    flat = entry.select("dim", "n", "mean", F.posexplode("products").alias("at", "product"))
    i, j = F.floor(F.col("at") / F.size("mean")).cast("int"), F.pmod(F.col("at"), F.size("mean")).cast("int")
    flat = flat.select("dim", "at", F.col("n").cast("double").alias("n"), F.get("mean", i).alias("a"), F.get("mean", j).alias("b"), "product")
    n = F.col("n")
    parts = flat.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("product") + n * F.col("a") * F.col("b")).alias("ab"), F.sum(n * F.col("a")).alias("a"), F.sum(n * F.col("b")).alias("b"))
    out: dict[int, float] = {}
    for r in parts.collect():
        size = project[r.dim].shape[1]
        got = r.ab / r.n - (r.a / r.n) * (r.b / r.n)
        out[r.dim] = max(out.get(r.dim, 0.0), abs(got - (r.at // size == r.at % size)))
    return out


def _deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sums of squares of ``n * x - S``, exactly; None beyond a long."""
    y = float(np.abs(x.astype(np.float64)).max()) * f.n + max(map(abs, f.sums), default=0)
    if y * y * x.shape[1] < LONG // 2:
        d = x * f.n - np.array(f.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = x.astype(object) * f.n - np.array(f.sums, object)
    return [int(v) if v <= LONG else None for v in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, conf: Whitening = Whitening(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable vector and component up to ``components``.

    Rows whose vector is null or holds null or non-finite entries are dropped. Each distinct vector of whole numbers (``whole``) counts
    once in the fit, repeated rows and null ids get rows of their own. Vectors of each length have a
    fit of their own; an empty vector has no components, nor has a component whose variance is nought but for rounding (all
    components if all vectors are equal). ``deviation`` is null beyond a long. An empty table gives an empty one; other columns are not read.

    Equal vectors are brought together in a count that combines before its shuffle; three passes over the distinct
    ones send sums, one matrix a task, and moments of the whitened components.
    """
    sound = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(sound).select("vec_id", whole(F.col("v"), conf).alias("x"))
    distinct = materialise(rows.select("x").distinct())
    fits = fit(distinct)
    errors = _identity_errors(distinct, fits, conf.components)
    project = {dim: f.projection(conf.components) for dim, f in fits.items()}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same, x in _stacked(batch):
                f, p = fits[dim], project[dim]
                k = p.shape[1]
                w = np.einsum("ij,jk->ik", _centred(x, f), p)
                deviation = pd.array(np.repeat(np.array(_deviations(x, f), object), k), "Int64")
                ids = pd.array(same["vec_id"].repeat(k), "Int64")
                explained = np.tile((f.values[:k] / f.trace).astype(np.float64), len(x))
                yield pd.DataFrame({"vec_id": ids, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": f.n, "deviation": deviation, "whitened": w.ravel(), "explained": explained, "identity_error": errors.get(dim)})

    return rows.mapInPandas(write, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
