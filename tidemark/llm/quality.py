"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.hashing import Spans, _lower, _space, mix, slices
from tidemark.llm.memory import released
from tidemark.tables import text_batches

#: The ASCII marks whose shares are features of their own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = (
    *(f"mark_{chr(c)}" for c in MARKS),
    *("letters", "upper", "digits", "high_bytes", "spaces", "newlines", "word_length", "long_words"),
    *("distinct_words", "same_as_before", "same_as_two_before", "words_upper", "words_marked_end", "words_all_marks", "line_words", "log_words"),
    *("most_marks", "most_upper", "least_distinct"),
)


@dataclass(frozen=True)
class Quality:
    """Parameters. ``positives`` trusted and ``unlabelled`` rows at most are learnt from.

    The score is shifted until the share ``lost`` of the trusted positives falls below ``threshold``.
    """

    positives: int = 4000
    unlabelled: int = 6000
    hidden: int = 24
    steps: int = 500
    rate: float = 0.02
    decay: float = 1e-4
    window: int = 64
    threshold: float = 0.7
    lost: float = 0.0015
    seed: int = 11


def features(run: list[bytes], window: int = 64) -> np.ndarray:
    """Shares of characters and words by kind, per text: one row of NAMES each, all zero without words."""
    data = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    low = _lower[data]
    ends = np.cumsum([len(x) + 1 for x in run])
    starts = ends - np.array([len(x) + 1 for x in run])
    size = np.maximum(1, ends - starts - 1)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag)))
        return sums[ends - 1] - sums[starts]

    out = np.zeros((len(run), len(NAMES)))
    put = lambda name, value: out.__setitem__((slice(None), NAMES.index(name)), value)
    text = np.repeat(np.arange(len(run)), ends - starts)
    counts = np.bincount(text * 256 + data, minlength=256 * len(run)).reshape(len(run), 256)
    for k, c in enumerate(MARKS):
        out[:, k] = counts[:, c] / size
    upper, lower_ = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
    high = counts[:, 0xC0:].sum(axis=1)
    put("letters", (upper + lower_ + high) / size)
    put("upper", upper / np.maximum(1, upper + lower_))
    put("digits", counts[:, 48:58].sum(axis=1) / size)
    put("high_bytes", high / size)
    put("spaces", counts[:, 32] / size)
    put("newlines", (counts[:, 10] - 1) / size)
    space = _space[low]
    before = np.concatenate(([True], space[:-1]))
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(start):
        return np.zeros_like(out)
    at = np.searchsorted(start, np.concatenate((starts, ends[-1:])))
    words = np.diff(at)
    n = np.maximum(1, words)
    owner = np.repeat(np.arange(len(run)), words)
    share = lambda flag: np.bincount(owner, weights=flag, minlength=len(run)) / n
    length = end - start
    hashes = Spans(low).of(start, end)
    is_mark = np.zeros(256, bool)
    is_mark[list(MARKS)] = True
    mark_sum = np.concatenate(([0], np.cumsum(is_mark[data])))
    upper_sum = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    low_sum = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    marks, uppers, lowers = (s[end] - s[start] for s in (mark_sum, upper_sum, low_sum))
    put("word_length", share(length) / 10)
    put("long_words", share(length > 20))
    same = lambda k: np.concatenate((np.zeros(min(k, len(hashes))), (hashes[k:] == hashes[:-k]) & (owner[k:] == owner[:-k])))
    put("same_as_before", share(same(1)))
    put("same_as_two_before", share(same(2)))
    shout, noisy = (uppers >= 2) & (lowers == 0), marks >= 2
    put("words_upper", share(shout))
    put("words_marked_end", share(noisy))
    put("words_all_marks", share(marks == length))
    put("line_words", np.minimum(1, words / np.maximum(1, counts[:, 10]) / 100))
    put("log_words", np.log1p(words) / 10)
    block = owner * 0 + (np.arange(len(start)) - at[owner]) // window
    key = owner.astype(np.int64) * (1 << 32) + block
    blocks, number = np.unique(key, return_inverse=True)
    many = np.bincount(number)
    of = (blocks >> 32).astype(int)
    fresh = np.bincount(number[np.unique(mix(hashes ^ mix(key.astype(np.uint64))), return_index=True)[1]], minlength=len(blocks)) / many
    put("distinct_words", np.bincount(of, weights=fresh * many, minlength=len(run)) / n)
    for name, value, sign in (("most_marks", np.bincount(number, weights=noisy) / many, 1), ("most_upper", np.bincount(number, weights=shout) / many, 1), ("least_distinct", fresh, -1)):
        most = np.full(len(run), -np.inf)
        np.maximum.at(most, of, np.where(many >= min(window, 16), sign * value, min(sign, 0)))
        put(name, np.where(np.isinf(most), 0, most))
    out[words == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    prior: float
    conf: Quality

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        w, b, v, c = self.layers
        z = np.tanh(((_warp(x) - self.mean) / self.scale) @ w + b) @ v + c
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _warp(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.sqrt(np.abs(x))


def risk(layers: list[np.ndarray], x: np.ndarray, k: int, prior: float) -> tuple[float, float]:
    """The two parts of the risk over ``k`` positives, which come first, and unlabelled rows: ``prior * R+``, and ``R-(unlabelled) - prior * R-(positives)``."""
    w, b, v, c = layers
    z = np.tanh(x @ w + b) @ v + c
    return prior * np.logaddexp(0, -z[:k]).mean(), np.logaddexp(0, z[k:]).mean() - prior * np.logaddexp(0, z[:k]).mean()


def _gradient(layers: list[np.ndarray], x: np.ndarray, k: int, prior: float, decay: float, non_negative: bool) -> list[np.ndarray]:
    """Of both parts' sum; where the second is below zero (and that is not allowed), of its negative alone. ``decay`` shrinks the weights."""
    w, b, v, c = layers
    hid, n = np.tanh(x @ w + b), len(x) - k
    z = hid @ v + c
    prob = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    off = np.empty_like(z)
    if non_negative and risk(layers, x, k, prior)[1] < 0:
        off[:k], off[k:] = prior * prob[:k] / k, -prob[k:] / n
    else:
        off[:k], off[k:] = (prior * (prob[:k] - 1) - prior * prob[:k]) / k, prob[k:] / n
    back = off[:, None] * v * (1 - hid**2)
    return [x.T @ back + decay * w, back.sum(axis=0), hid.T @ off + decay * v, off.sum()]


def _train(pos: np.ndarray, unl: np.ndarray, prior: float, conf: Quality, non_negative: bool) -> tuple[np.ndarray, ...]:
    """Adam on ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` with the logistic loss.

    Where the second part falls below zero the step climbs it instead, so that it cannot be fitted away.
    """
    rng = np.random.default_rng(conf.seed)
    layers = [rng.normal(0, pos.shape[1] ** -0.5, (pos.shape[1], conf.hidden)), np.zeros(conf.hidden), rng.normal(0, conf.hidden**-0.5, conf.hidden), np.zeros(())]
    x, k = np.concatenate((pos, unl)), len(pos)
    m, s = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, conf.steps + 1):
        for i, g in enumerate(_gradient(layers, x, k, prior, conf.decay, non_negative)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            layers[i] = layers[i] - conf.rate * (1 - step / conf.steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Positives among the unlabelled, from the scores of a classifier of one against the other.

    Above any score, unlabelled rows are at least prior times as frequent as positives; the
    smallest such ratio, over cuts that leave enough of both, estimates the prior.
    """
    cuts = np.quantile(pos, np.linspace(0.01, 0.9, 60))
    ratio = [(unl >= t).mean() / max(1e-9, (pos >= t).mean()) for t in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, conf: Quality = Quality()) -> Model:
    """The prior is estimated on halves that its classifier has not seen; then the non-negative risk is minimised.

    It leaves the score's place open where the prior is a little off; the trusted positives set it.
    """
    width = len(NAMES)
    if len(pos) < 4 or len(unl) < 4:
        return Model(np.zeros(width), np.ones(width), (), 1.0 if len(pos) else 0.0, conf)
    both = _warp(np.concatenate((pos, unl)))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    p, u = both[: len(pos)], both[len(pos) :]
    p, u = (p - mean) / scale, (u - mean) / scale
    first = Model(np.zeros(width), np.ones(width), _train(p[::2], u[::2], 0.5, conf, False), 0.5, conf)
    w, b, v, c = first.layers
    judge = lambda x: np.tanh(x @ w + b) @ v + c
    prior = class_prior(judge(p[1::2]), judge(u[1::2]))
    w, b, v, c = _train(p, u, prior, conf, True)
    lowest = np.quantile(np.tanh(p @ w + b) @ v + c, conf.lost)
    return Model(mean, scale, (w, b, v, c + np.log(conf.threshold / (1 - conf.threshold)) - lowest), prior, conf)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves remainder 2 by 4; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(docs: DataFrame, conf: Quality) -> DataFrame:
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(batches):
            yield pd.Series([row for _, run in slices(texts.tolist()) for row in features(run, conf.window)])

    return docs.withColumn("features", measured(F.coalesce("text", F.lit("")))).drop("text")


def train(docs: DataFrame, labels: DataFrame, conf: Quality = Quality()) -> Model:
    """Learn from trusted positives (quality 1) and any documents as unlabelled, both outside the held-out rows.

    The two samples are the rows of smallest hashed id, ``positives`` and ``unlabelled`` at most; only
    their features, of fixed width, come to the driver.
    """
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.positives).withColumn("trusted", F.lit(True))
    rest = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    rest = rest.orderBy(F.xxhash64("doc_id", F.lit(conf.seed)), "doc_id").limit(conf.unlabelled).withColumn("trusted", F.lit(False))
    rows = good.unionByName(rest).distinct().collect()
    if not rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros((0, len(NAMES))), conf)
    picked = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, trusted boolean"))
    got = _features(docs.select("doc_id", "text").join(picked, "doc_id"), conf).orderBy("doc_id", "trusted", "features").collect()
    take = lambda trusted: np.array([r.features for r in got if r.trusted == trusted]).reshape(-1, len(NAMES))
    return fit(take(True), take(False), conf)


def quality(docs: DataFrame, labels: DataFrame, conf: Quality = Quality()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text; null counts as empty.

    A map of the rows with a small broadcast model. Without positives every score is 0; without
    anything to set them against, 1. Rows that repeat an id are scored (and, if picked, learnt from) one by one; null ids are scored, never
    held out nor learnt from. An empty table gives an empty one; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, conf))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(batches):
            parts = [sent.value(features(run, conf.window)) for _, run in slices(texts.tolist())]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = docs.select("doc_id", probability(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= conf.threshold).cast("int").alias("predicted"))
