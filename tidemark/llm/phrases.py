"""Phrase collocations by prefix-free parsing: content-triggered chunks, counted once each with their frequency.

Chunks overlap by one word less than a phrase has at most, and a phrase belongs to the chunk that it begins in before the overlap, so it is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.hashing import BASE, BASE_INVERSE, Spans, mix, powers, slices
from tidemark.llm.members import IdFilter
from tidemark.llm.memory import released
from tidemark.tables import materialise


@dataclass(frozen=True)
class Mining:
    """Parameters: phrases of 2 to ``words`` words that occur ``least`` times; one in ``modulus`` windows of words ends a chunk,
    and no chunk goes on for more than ``longest``; scores are in units of 1 / ``scale``; a phrase is dropped for a longer
    one that has ``cover`` percent of its occurrences; ``top`` phrases of each language are returned."""

    words: int = 4
    least: int = 30
    modulus: int = 16
    longest: int = 64
    scale: int = 2_000_000
    cover: int = 80
    top: int = 2000


#: Bytes of text, or of chunks, that are parsed at once; a longer text is parsed alone.
AT_ONCE = 1 << 21
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
LANGUAGE = "und"

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: 0 in words, 1 between words, 2 between pieces.
_kind = np.zeros(256, np.uint8)
_kind[[0x20, 0x09]] = 1
_kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def seed_of(lang: str) -> int:
    """A number for a language: words of different languages get different keys."""
    raw = np.frombuffer(lang.encode(), np.uint8)
    return int(mix(Spans(raw).of(np.array([0]), np.array([len(raw)])) * STEP)[0])


def joined(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of a phrase from those of all its words but the last, and of the last."""
    return mix(head * STEP + last)


def _runs(keys: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for each run of word keys."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * powers(BASE, len(keys)), out=sums[1:])
    return mix((sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(keys) + 1)[begins] + (ends - begins).astype(np.uint64))


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each distinct key, and the sum of its weights."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    return order[first], np.add.reduceat(weights[order], first)


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data[begin:end]`` of each pair, as an Arrow column."""
    sizes = ends - begins
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def _parsed(run: list[bytes], langs: np.ndarray, seeds: np.ndarray, conf: Mining) -> pa.RecordBatch | None:
    """The distinct chunks of some texts; ``langs`` numbers each text's language, ``seeds`` has one for each number."""
    data = _lower[np.frombuffer(b"\n".join(run) + b"\n", np.uint8)]
    kind = _kind[data]
    inside = kind == 0
    before = np.concatenate(([False], inside[:-1]))
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    m = len(start)
    if not m:
        return None
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in run]), start, side="right")
    lang = langs[text]
    keys = mix(Spans(data).of(start, end) ^ seeds[lang])
    piece = np.cumsum(kind == 2)[start]
    kept = inside.copy()
    kept[end] = True  # one space after each word
    place = np.cumsum(kept)
    flat = np.where(inside, data, np.uint8(32))[kept]
    start, end = place[start] - 1, place[end] - 1

    head = np.concatenate(([True], piece[1:] != piece[:-1]))
    firsts = np.flatnonzero(head)
    piece_end = np.repeat(np.append(firsts[1:], m), np.diff(np.append(firsts, m)))
    overlap = conf.words - 1
    window = keys[: max(0, m - overlap + 1)].copy()
    for k in range(1, overlap):
        window = window * STEP + keys[k : len(window) + k]
    index = np.arange(m)
    begins = head.copy()
    begins[: len(window)] |= (mix(window) % np.uint64(conf.modulus) == 0) & (index[: len(window)] + overlap <= piece_end[: len(window)])
    since = index - np.maximum.accumulate(np.where(begins, index, 0))
    begins |= since % conf.longest == 0
    first = np.flatnonzero(begins)
    next_first = np.append(first[1:], m)
    last = np.minimum(next_first + overlap, piece_end[first])
    one, times = _grouped(_runs(keys, first, last) + (next_first - first).astype(np.uint64), np.ones(len(first), np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(lang[first[one]], pa.int32()), _strings(flat, start[first[one]], end[last[one] - 1]), pa.array((next_first - first)[one], pa.int32()), pa.array(times)], ["lang", "chunk", "own", "times"]
    )


def parse(docs: DataFrame, conf: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The dictionary of ``docs``: ``lang, chunk, own, times`` for each distinct chunk, its words joined by single spaces.

    A chunk begins where a piece does or where the hash of the next ``words - 1`` words is a multiple of ``modulus``, and ends with
    the words that begin the next; ``own`` counts its words before those. Null texts are empty, null languages ``und``. An empty table gives an empty one.
    """
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit(LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            named = pc.dictionary_encode(batch.column("lang"))
            seeds = np.array([seed_of(x) for x in named.dictionary.to_pylist()], np.uint64)
            langs = named.indices.to_numpy()
            for first, run in slices(batch.column("text").to_pylist(), AT_ONCE):
                found = _parsed(run, langs[first : first + len(run)], seeds, conf)
                if found is not None:
                    names = named.dictionary.take(found.column("lang"))
                    yield pa.RecordBatch.from_arrays([names, *found.columns[1:]], found.schema.names)

    chunks = slim.mapInArrow(read, "lang string, chunk string, own int, times long")
    return materialise(chunks.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times")))


@dataclass(frozen=True)
class _Words:
    """The words of some chunks: key, chunk, place in ``data``; whether a phrase that begins here counts here; the chunk's times; and languages."""

    key: np.ndarray
    chunk: np.ndarray
    own: np.ndarray
    times: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    langs: pa.Array


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    held: list[pa.RecordBatch] = []
    size = 0

    def work() -> _Words:
        rows = pa.Table.from_batches(held).combine_chunks()
        named = pc.dictionary_encode(rows.column("lang").chunk(0))
        seeds = np.array([seed_of(x) for x in named.dictionary.to_pylist()], np.uint64)
        chunk = rows.column("chunk").chunk(0)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_string(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = data != 32
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        of = np.searchsorted(offsets, start, side="right") - 1
        number = np.arange(len(start)) - np.searchsorted(of, np.arange(len(chunk)))[of]
        key = mix(Spans(data).of(start, end) ^ seeds[named.indices.to_numpy()][of])
        return _Words(key, of, number < rows.column("own").to_numpy()[of], rows.column("times").to_numpy()[of], data, start, end, rows.column("lang").chunk(0))

    for batch in released(batches):
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= AT_ONCE:
            yield work()
            held, size = [], 0
    if held:
        yield work()


def _count_words(chunks: DataFrame) -> DataFrame:
    """``lang, key, word, n`` of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _words(batches):
            own = np.flatnonzero(w.own)
            at, n = _grouped(w.key[own], w.times[own])
            at = own[at]
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.chunk[at])), pa.array(w.key[at].view(np.int64)), _strings(w.data, w.start[at], w.end[at]), pa.array(n)], ["lang", "key", "word", "n"])

    return chunks.mapInArrow(count, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def _count_phrases(chunks: DataFrame, sizes: range, often: IdFilter, conf: Mining) -> DataFrame:
    """``size, head, last, n`` of the phrases of ``sizes`` words that occur ``least`` times, by keys.

    ``often`` knows the keys of those phrases, one word shorter than the first of ``sizes``, that do; a phrase is counted only
    where all phrases of that size within it pass, since it occurs no more often than any of them.
    """
    base = sizes.start - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _words(batches):
            m = len(w.key)
            keys = {1: w.key}
            for k in range(2, sizes.stop):
                keys[k] = joined(keys[k - 1][: max(0, m - k + 1)], w.key[k - 1 :])
            frequent = often(keys[base].view(np.int64)) if m >= base else np.zeros(0, bool)
            for k in sizes:
                n = m - k + 1
                if n <= 0:
                    continue
                good = w.own[:n] & (w.chunk[:n] == w.chunk[k - 1 :])
                for j in range(k - base + 1):
                    good &= frequent[j : j + n]
                at = np.flatnonzero(good)
                one, times = _grouped(keys[k][at], w.times[at])
                at = at[one]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(keys[k - 1][at].view(np.int64)), pa.array(w.key[at + k - 1].view(np.int64)), pa.array(times)], ["size", "head", "last", "n"])

    counted = chunks.mapInArrow(count, "size int, head long, last long, n long").groupBy("size", "head", "last").agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") >= conf.least))


def phrase_counts(docs: DataFrame, conf: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, n`` of every phrase of 1 to ``words`` words that occurs ``least`` times in a language, and ``lang, n``, its word occurrences."""
    chunks = parse(docs, conf, text_col, lang_col)
    words = materialise(_count_words(chunks))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    single = words.where(F.col("n") >= conf.least)
    found = [materialise(single.select("lang", "key", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n"))]
    word = found[0].select(F.col("key").alias("last"), F.col("phrase").alias("word"))

    @F.pandas_udf("long")
    def key(head: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series(joined(head.to_numpy().view(np.uint64), last.to_numpy().view(np.uint64)).view(np.int64))

    def resolved(counted: DataFrame, shorter: DataFrame) -> DataFrame:
        of = shorter.select(F.col("key").alias("head"), "lang", F.col("phrase").alias("start"))
        named = counted.withColumn("key", key("head", "last")).join(of, "head").join(word, "last")
        return materialise(named.select("lang", "key", F.concat_ws(" ", "start", "word").alias("phrase"), "size", "n"))

    counted = _count_phrases(chunks, range(2, 3), IdFilter(found[0].select("key")), conf)
    found.append(resolved(counted, found[0]))
    if conf.words > 2:
        counted = _count_phrases(chunks, range(3, conf.words + 1), IdFilter(found[1].select("key")), conf)
        for k in range(3, conf.words + 1):
            found.append(resolved(counted.where(F.col("size") == k), found[-1]))
    return reduce(DataFrame.unionByName, (f.drop("key") for f in found)), totals


def collocations(docs: DataFrame, conf: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    Texts are lowered (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words; null texts are empty and null languages
    ``und``. ``a`` counts a phrase, ``l`` and ``r`` the two parts of the cut that gives the lowest
    ``score``, ``floor(scale * a / (l + r))``, of equal ones the first; ``n`` counts the language's words. A phrase within a longer one (dropped or not) that has
    ``cover`` percent of its occurrences is dropped. Repeated rows count each; an empty table, or one without phrases of ``least``
    occurrences, gives an empty one. Words and phrases are told apart by 64-bit keys of word and language.

    Distinct chunks shuffle once, with their number. Words are counted in them, then pairs of frequent words, then longer phrases of
    frequent pairs; membership is a bitmap of bounded size, and false members fall to the exact counts.
    """
    found, totals = phrase_counts(docs, conf, text_col, lang_col)
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("both", wide("l") + wide("r")).withColumn("scaled", wide("a") * F.lit(conf.scale).cast("decimal(10,0)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("scaled div both").alias("score"), "k", "l", "r")).alias("best"))
    longer = phrases.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    longer = longer.select("lang", "a", part(F.col("i"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * conf.cover))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= conf.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
