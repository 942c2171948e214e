"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashing import Spans, _lower, _space, mix, slices
from tidemark.llm.memory import released
from tidemark.tables import text_batches

GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Toxicity:
    """Parameters. ``sample`` labelled rows of each class at most are learnt from, in an order their ids decide and with whole texts, of
    ``most_bytes`` in all: a row whose text no longer fits is passed over. Scores cover whole texts."""

    sample: tuple[int, int] = (3000, 1500)
    most_bytes: int = 12_000_000
    window: int = 8
    bits: int = 20
    dim: int = 8
    epochs: int = 5
    batch: int = 2048
    rate: float = 0.4
    decay: float = 1e-3
    least_texts: int = 5
    calibrate: int = 5
    threshold: float = 0.5
    seed: int = 7


class Bags:
    """The words of some texts as they stand, the features of each distinct one, and windows of words at half their length's stride.

    ``feats[first[u]:first[u + 1]]`` are the buckets of distinct word ``u``, ``word`` numbers every occurrence's, and window ``k``
    covers ``word[low[k]:high[k]]`` of text ``text[k]``; the last window of a text ends with it.
    """

    def __init__(self, feats: np.ndarray, first: np.ndarray, word: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray):
        self.feats, self.first, self.word, self.low, self.high, self.text = feats, first, word, low, high, text

    @classmethod
    def read(cls, run: list[bytes], conf: Toxicity) -> Bags:
        data = _lower[np.frombuffer(b"\n".join(run) + b"\n", np.uint8)]
        space = _space[data]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        end = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in run]), start, side="right")
        words, once, word = np.unique(Spans(data).of(start, end), return_index=True, return_inverse=True)
        windows = _windows(np.searchsorted(text, np.arange(len(run) + 1)), conf.window)
        start, end = start[once], end[once]
        size = end - start + 1
        word_start = np.cumsum(size) - size + 1
        total = int(size.sum())
        own = np.full(total + 1, 32, np.uint8)
        source = np.arange(total) + np.repeat(start - word_start + 1, size)
        own[1:] = np.where(np.arange(total) == np.repeat(word_start + size - 2, size), 32, data[source])
        space = own == 32
        shift = np.uint64(64 - conf.bits)
        buckets = np.full((len(own), 1 + len(GRAMS)), -1, np.int32)
        buckets[word_start, 0] = (words >> shift).astype(np.int32)
        code, inside = np.zeros(len(own), np.uint64), np.zeros(len(own), bool)
        for n in range(1, max(GRAMS) + 1):
            size = len(own) - n + 1
            if size <= 0:
                break
            code = (code[:size] << np.uint64(8)) | own[n - 1 :].astype(np.uint64)
            inside = inside[:size] | space[n - 2 : n - 2 + size] if n > 2 else np.zeros(size, bool)
            if n in GRAMS:
                buckets[:size, 1 + GRAMS.index(n)] = np.where(inside, -1, (mix(code + np.uint64(n)) >> shift).astype(np.int32))
        used = buckets >= 0
        first = np.concatenate(([0], np.cumsum(used.sum(axis=1))))[np.concatenate((word_start - 1, [len(own) - 1]))]
        return cls(buckets[used], first, word, *windows)

    def scores(self, value: np.ndarray) -> np.ndarray:
        """The mean value of each window's features."""
        if not len(self.low):
            return np.zeros(0)
        of_word = np.add.reduceat(value[self.feats], self.first[:-1], dtype=np.float64)
        sums = np.concatenate(([0.0], np.cumsum(of_word[self.word])))
        counts = np.concatenate(([0], np.cumsum(np.diff(self.first)[self.word])))
        return (sums[self.high] - sums[self.low]) / (counts[self.high] - counts[self.low])


def _windows(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word, and text, of every window over texts whose words begin at ``bounds``."""
    stride = max(1, window // 2)
    n = np.diff(bounds)
    many = np.where(n > window, 1 - (window - n) // stride, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    low = bounds[text] + np.minimum(k * stride, np.maximum(0, n[text] - window))
    return low, np.minimum(low + window, bounds[text + 1]), text


@dataclass(frozen=True)
class Model:
    """What the softmax adds for a feature's embedding, and its bias: the score is linear in the mean."""

    value: np.ndarray
    bias: float
    conf: Toxicity

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the largest probability over its windows; the bias alone decides where it has no words."""
        best = np.full(len(texts), -np.inf)
        for first, run in slices(texts):
            bags = Bags.read(run, self.conf)
            np.maximum.at(best, first + bags.text, bags.scores(self.value) + self.bias)
        best[np.isinf(best)] = min(self.bias, 0.0) - 1.0
        return 1 / (1 + np.exp(-np.clip(best, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, conf: Toxicity) -> Model:
    """Train embeddings and softmax jointly by Adagrad on windows that bear their text's label.

    After the first epoch only the windows of a toxic text that the model itself finds
    toxic, and its most toxic one, keep the label: most windows of such a text are clean. Buckets of fewer than
    ``least_texts`` texts stay at zero. Every ``calibrate``-th text is left out and sets the
    bias where the fewest of them are judged wrongly.
    """
    buckets = 1 << conf.bits
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(buckets, np.float32), 50.0 if len(labels) and labels[0] else -50.0, conf)
    kept = np.arange(len(texts)) % conf.calibrate != 0 if np.bincount(labels).min() >= 20 * conf.calibrate else np.ones(len(texts), bool)
    model = _fit([t for t, k in zip(texts, kept, strict=True) if k], labels[kept], conf)
    if kept.all():
        return model
    odds = model([t for t, k in zip(texts, kept, strict=True) if not k])
    odds, rest = np.log(odds / (1 - odds)), labels[~kept]
    order = np.argsort(odds)
    odds, rest = odds[order], rest[order]
    wrong = np.concatenate(([0], np.cumsum(rest == 1))) + np.concatenate((np.cumsum((rest == 0)[::-1])[::-1], [0]))
    cut = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate(([odds[0] - 1], odds, [odds[-1] + 1]))
    return Model(model.value, model.bias - float(edges[cut[0]] + edges[cut[-1] + 1]) / 2, conf)


def gradient(table: np.ndarray, soft: np.ndarray, bias: np.ndarray, at: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The summed cross entropy of windows of ``n`` features each (``at``, one window after the other), and its gradients.

    Those of the embeddings come as one number for each: both classes' errors are opposite, so all lie along ``soft[1] - soft[0]``.
    """
    mean = np.add.reduceat(table[at], np.cumsum(n) - n) / n[:, None]
    logits = mean @ soft.T + bias
    off = np.exp(logits - logits.max(axis=1, keepdims=True))
    off /= off.sum(axis=1, keepdims=True)
    row = np.arange(len(n))
    loss = -float(np.log(np.maximum(off[row, target], 1e-30)).sum())
    off[row, target] -= 1
    pull = np.bincount(at, weights=np.repeat(off[:, 1] / n, n), minlength=len(table))
    return loss, pull, off.T @ mean, off.sum(axis=0)


def _joined(texts: list[str], conf: Toxicity) -> tuple[Bags, np.ndarray]:
    """The words and windows of all ``texts``, and in how many texts each bucket occurs."""
    texts_of = np.zeros(1 << conf.bits, np.int64)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("feats", "first", "word", "low", "high", "text")}
    words = feats = distinct = 0
    for begin, run in slices(texts, 1 << 20):  # distinct words of a longer run are fewer
        bags = Bags.read(run, conf)
        if len(bags.low):
            owner = np.zeros(len(bags.word), np.int64)
            owner[bags.low] = bags.text
            owner = np.maximum.accumulate(owner)
            pair = np.unique(owner * len(bags.first) + bags.word)
            of, many = pair // len(bags.first), np.diff(bags.first)[pair % len(bags.first)]
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bags.first[pair % len(bags.first)], many)
            texts_of += np.bincount(np.unique(np.repeat(of, many) << conf.bits | bags.feats[inner]) & ((1 << conf.bits) - 1), minlength=len(texts_of))
            for name, value in (("feats", bags.feats), ("first", bags.first[:-1] + feats), ("word", (bags.word + distinct).astype(np.int32)), ("low", bags.low + words), ("high", bags.high + words), ("text", bags.text + begin)):
                parts[name].append(value)
            words, feats, distinct = words + len(bags.word), feats + len(bags.feats), distinct + len(bags.first) - 1
    parts["first"].append(np.array([feats]))
    none = np.zeros(0, np.int32)
    return Bags(**{name: np.concatenate([none, *parts.pop(name)]) for name in list(parts)}), texts_of


def _fit(texts: list[str], labels: np.ndarray, conf: Toxicity) -> Model:
    buckets = 1 << conf.bits
    bags, texts_of = _joined(texts, conf)
    rare = texts_of < min(conf.least_texts, max(1, len(texts) // 100))
    rng = np.random.default_rng(conf.seed)
    table = np.zeros((buckets, conf.dim), np.float32)
    soft, bias = rng.normal(0, 1, (2, conf.dim)).astype(np.float32), np.array([2.0, -2.0], np.float32)
    seen_table, seen_soft, seen_bias = np.full(buckets, 1e-6, np.float32), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    windows = len(bags.low)
    target = labels[bags.text]
    batch = int(min(conf.batch, max(64, windows // 100)))
    many = np.diff(bags.first)
    for epoch in range(conf.epochs):
        if epoch:
            score = bags.scores(table @ (soft[1] - soft[0])) + bias[1] - bias[0]
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, bags.text, score)
            target = ((labels[bags.text] == 1) & ((score > 0) | (score == best[bags.text]))).astype(np.int64)
        order = rng.permutation(np.arange(epoch % 2, windows, 2))  # windows overlap by half: each epoch learns from every other one
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            long = bags.high[pick] - bags.low[pick]
            word = bags.word[np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(bags.low[pick], long)]
            f = many[word]
            n = np.add.reduceat(f, np.cumsum(long) - long)
            at = bags.feats[np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f) + np.repeat(bags.first[word], f)]
            _, pull, grad_soft, grad_bias = gradient(table, soft, bias, at, n, target[pick])
            toward = soft[1] - soft[0]
            pull = pull.astype(np.float32)
            pull[rare] = 0
            hit = np.flatnonzero(pull)
            seen_table[hit] += pull[hit] ** 2 * float(toward @ toward) / conf.dim
            table[hit] *= 1 - conf.decay
            table[hit] -= conf.rate * (pull[hit] / np.sqrt(seen_table[hit]))[:, None] * toward
            seen_soft += grad_soft**2
            soft -= (0.1 * grad_soft / np.sqrt(seen_soft)).astype(np.float32)
            seen_bias += grad_bias**2
            bias -= (0.1 * grad_bias / np.sqrt(seen_bias)).astype(np.float32)
    return Model((table @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]), conf)


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves remainder 0 by 5; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, out, most: dict[int, int], most_bytes: int) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most ``most[c]`` labelled rows of each class outside ``out``, by a hash of their ids, of ``most_bytes`` in all.

    Only ids and sizes of so many rows are gathered first; they meet the documents by broadcast, so texts that are not picked do not move.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    picked = None
    for value, n in most.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    rows, kept = picked.collect(), []
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def of(found: list) -> DataFrame:
        ids = pa.table({"doc_id": pa.array([r.doc_id for r in found], pa.int64()), "label": pa.array([r.label for r in found], pa.int32())})
        return slim.join(F.broadcast(docs.sparkSession.createDataFrame(ids)), "doc_id")

    if rows:
        sizes: dict[int, list[int]] = {}
        for r in of(rows).select("doc_id", F.octet_length("text").alias("bytes")).collect():
            sizes.setdefault(r.doc_id, []).append(r.bytes)
        room, place, turns = most_bytes, dict.fromkeys(most, 0), []
        for r in rows:
            place[r.label] += 1
            turns.append((place[r.label], r.label, r))
        for _, _, r in sorted(turns, key=lambda t: t[:2]):  # the classes in turn, so that none is left without room
            size = sum(sizes.get(r.doc_id, []))
            if size <= room:
                kept.append(r)
                room -= size
    got = of(kept).orderBy("doc_id", "text", "label").collect() if kept else []
    got = list({r.doc_id: r for r in got}.values())
    return [r.text for r in got], np.array([r.label for r in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, conf: Toxicity = Toxicity()) -> Model:
    texts, marks = sample(docs, labels, "toxic", held_out, dict(enumerate(conf.sample)), conf.most_bytes)
    return fit(texts, marks, conf)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text in ``out``; null counts as empty, which is never toxic.

    A map of the rows; the model (2**bits floats) is broadcast. A column by the name ``out`` is replaced.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        for texts in released(batches):
            yield pd.Series(model(texts.tolist()))

    return docs.withColumn(out, probability(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, conf: Toxicity = Toxicity()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; learnt from labels outside the held-out rows.

    Null counts as empty, and an empty text is never toxic. Without labels of both classes the score is 0 (or 1 where all are
    toxic). Rows that repeat an id are scored one by one, and one of them is learnt from; null ids are scored, never held out nor learnt from.
    An empty table gives an empty one; other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, conf))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= conf.threshold).cast("int").alias("predicted"))
