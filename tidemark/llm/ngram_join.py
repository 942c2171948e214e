"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import counters
from tidemark.llm.hashing import shingle_sets, slices
from tidemark.llm.memory import released
from tidemark.llm.members import IdFilter, survivors, without
from tidemark.operators.components import connected_components
from tidemark.tables import materialise, text_batches


@dataclass(frozen=True)
class Join:
    """Parameters: words of a shingle, the threshold as a fraction, and how prefixes adapt.

    ``slots`` counters (by default in proportion to the documents, see ``counters_for``) estimate how often shingles occur; the
    shared prefix tokens asked for are ``few`` or one in ``spread`` of the set's at most; ``verify`` is the cost of a
    candidate for each token, in units of one posting; ``usual_load`` is the least estimate of the other
    documents with a token, which counters shared with other tokens hide; a token's list is dealt in parts of
    about ``part`` rows. Sets are compared in blocks of about ``block`` sets or ``block_tokens`` tokens.
    """

    width: int = 5
    numerator: int = 75
    denominator: int = 100
    slots: int | None = None
    few: int = 8
    spread: int = 16
    verify: float = 1.0
    usual_load: float = 0.2
    part: int = 20_000
    block: int = 512
    block_tokens: int = 500_000


def _least_overlap(n: int, join: Join) -> int:
    """The fewest shared tokens of a set of n and any set linked to it."""
    return -(-n * join.numerator // join.denominator)


def counters_for(rows: int) -> int:
    """Counters for a table of ``rows`` documents: four for each, a power of two from 2**20 to 2**24 (64 MB at the driver).

    They only order tokens and steer the prefix lengths: with too few, rare tokens are told apart less well and
    prefixes grow longer, but no result changes.
    """
    return min(1 << 24, max(1 << 20, 1 << (4 * rows).bit_length()))


def _summaries(docs: DataFrame, join: Join) -> DataFrame:
    """For every row its set's size and two order-free sums of its hashes; and chunks of the token counts."""
    shift = np.uint64(64 - (join.slots - 1).bit_length())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(join.slots, np.uint32)
        for batch in released(batches):
            size, one, two, slot = [], [], [], []
            for _, run in slices(batch["text"].tolist()):
                sets = shingle_sets(run, join.width)
                size += [len(s) for s in sets]
                one += [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                two += [int((s * (s | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                slot.append((np.concatenate(sets) >> shift).astype(np.int32))
            if slot:
                seen += np.bincount(np.concatenate(slot), minlength=join.slots).astype(np.uint32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": size, "one": one, "two": two, "chunk": None, "counts": None}).astype({"n": "int64"})
        part = counters.chunks(seen)
        yield pd.DataFrame({"doc_id": None, "n": None, "one": None, "two": None, "chunk": part["chunk"], "counts": part["counts"]})

    return materialise(docs.mapInPandas(read, "doc_id long, n long, one long, two long, chunk int, counts binary"))


def _matches(load: np.ndarray, n: int, overlap: int, join: Join) -> int:
    """How many shared prefix tokens to ask for: the number of least estimated cost.

    ``load`` estimates, in prefix order, the other documents that hold each token. Asking for m
    lengthens the prefix by m - 1 tokens and divides the candidates by m at least.
    """
    most = min(max(join.few, n // join.spread), overlap)
    m = np.arange(1, most + 1)
    postings = np.cumsum(load)[n - overlap : n - overlap + most]
    return int(m[np.argmin(m + postings + join.verify * n * postings / m)])


def _postings(docs: DataFrame, seen: Broadcast, usual: float, join: Join, but: IdFilter | None = None) -> DataFrame:
    """``token, salt, doc_id, matches, place`` for the prefix of every set; ``place`` counts the set's tokens before this one.
    Long lists are dealt in parts by ``salt``, which is -1 for others. Documents that pass ``but`` are left out.
    """
    shift = np.uint64(64 - (join.slots - 1).bit_length())
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = seen.value
        for batch in released(batches):
            if but is not None:
                batch = batch[~but(batch["doc_id"].to_numpy())]
            ids = batch["doc_id"].to_numpy()
            for first, run in slices(batch["text"].tolist()):
                out: list[tuple[np.ndarray, ...]] = []
                for doc, tokens in zip(ids[first:], shingle_sets(run, join.width), strict=False):
                    n = len(tokens)
                    if not n:
                        continue
                    often = counts[(tokens >> shift).astype(np.int64)]
                    order = np.argsort(often, kind="stable")
                    overlap = _least_overlap(n, join)
                    load = np.maximum(join.usual_load, often[order] - usual)
                    m = _matches(load, n, overlap, join)
                    take = order[: n - overlap + m]
                    salts = (load[: len(take)] / join.part).astype(np.int32) + 1
                    salt = np.where(salts > 1, doc % salts, -1).astype(np.int32)
                    out.append((tokens[take].view(np.int64), salt, np.full(len(take), doc), np.full(len(take), m, np.int32), np.arange(len(take), dtype=np.int32)))
                if out:
                    token, salt, doc, m, place = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"token": token, "salt": salt, "doc_id": doc, "matches": m, "place": place})

    return docs.mapInPandas(emit, "token long, salt int, doc_id long, matches int, place int")


@dataclass(frozen=True)
class _Posted:
    """What the join holds: rows of all documents, the sets by size, and the lists of prefix tokens that several hold."""

    rows: DataFrame
    sizes: DataFrame
    docs: DataFrame
    lists: DataFrame


def _post(docs: DataFrame, join: Join) -> _Posted:
    """Classes of equal sets, and the token lists of one document of each class."""
    read = _summaries(docs, join)
    rows = read.where("chunk is null").select("doc_id", "n", "one", "two")
    seen = counters.gather(read.where("chunk is not null").select("chunk", "counts"), join.slots)
    some = rows.where("doc_id is not null and n > 0")
    classes = materialise(some.groupBy("n", "one", "two").agg(F.min("doc_id").alias("class_id")))
    rows = materialise(rows.join(classes, ["n", "one", "two"], "left").select("doc_id", "n", "class_id"))
    sizes = rows.where("doc_id = class_id").select("doc_id", "n").distinct()
    copies = materialise(rows.where("doc_id <> class_id").select("doc_id"))
    docs = docs.where("doc_id is not null")
    in_list = Window.partitionBy("token", "salt").orderBy("doc_id")
    sent, usual, copy = docs.sparkSession.sparkContext.broadcast(seen), float(np.median(seen)), IdFilter(copies)
    lists = _postings(docs, sent, usual, join, copy).unionByName(_postings(survivors(docs, "doc_id", copies, copy), sent, usual, join))
    lists = lists.repartition("token", "salt")
    lists = lists.withColumns({"before": F.lag("doc_id").over(in_list), "next": F.lead("doc_id").over(in_list)})
    lists = lists.where("next is not null or before is not null or salt >= 0")
    lists = lists.select("token", "doc_id", "matches", "place", F.col("doc_id").alias("component"))
    return _Posted(rows, sizes, docs, materialise(lists))


def _sets(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """``id, tokens`` of the documents among ``ids``, read again; a few others may come along."""
    wanted = IdFilter(ids)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in released(batches):
            batch = batch[wanted(batch["doc_id"].to_numpy())]
            ids = batch["doc_id"].to_numpy()
            for first, run in slices(batch["text"].tolist()):
                sets = shingle_sets(run, join.width)
                yield pd.DataFrame({"id": ids[first : first + len(sets)], "tokens": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(read, "id long, tokens array<long>")


def _links_in_unit(ids: np.ndarray, tokens: np.ndarray, inner: int, join: Join) -> Iterator[tuple[int, int]]:
    """One link, ``(inner id, outer id)``, of each set from position ``inner`` on that links with any of those before."""
    size = np.array([len(t) for t in tokens])
    held = np.concatenate(tokens[:inner])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(inner), size[:inner])[order]
    for k in range(inner, len(ids)):
        low = np.searchsorted(held, tokens[k], side="left")
        many = np.searchsorted(held, tokens[k], side="right") - low
        at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        both = np.bincount(owner[at], minlength=inner)
        whole = size[:inner] + size[k] - both
        linked = np.flatnonzero((both * join.denominator >= whole * join.numerator) & (ids[:inner] != ids[k]))
        if len(linked):
            yield int(ids[linked[0]]), int(ids[k])


def _linked(inner: DataFrame, outer: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """Links ``a, b`` between the sets that ``inner`` and ``outer`` (``hub, id, n``) hold of the same hub: at least one for
    every outer set that links with any of the hub's inner ones.

    Both sides of a hub are dealt in blocks, and each pair of blocks is a unit of its own, which counts common tokens
    on whole sets. Pairs never leave their unit; what shuffles is a set for each block it meets.
    """
    amount = F.greatest(F.count(F.lit(1)) / join.block, F.sum("n") / join.block_tokens)
    blocks = lambda side, name: side.groupBy("hub").agg(F.ceil(amount).cast("int").alias(name))
    dealt = materialise(blocks(inner, "rows").join(blocks(outer, "columns"), "hub"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = inner.join(dealt, "hub").select("hub", "id", F.lit(0).alias("outer"), mine("rows").alias("i"), every("columns").alias("j"))
    two = outer.join(dealt, "hub").select("hub", "id", F.lit(1).alias("outer"), every("rows").alias("i"), mine("columns").alias("j"))
    units = materialise(one.unionByName(two))
    sets = _sets(docs, materialise(units.select("id").distinct()), join)  # as large as the texts: straight into the join, not written
    unit = ["hub", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in chain(released(batches), [None]):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest is None or not len(rest):
                continue
            key, ids, outer, tokens = rest[unit].to_numpy(), rest["id"].to_numpy(), rest["outer"].to_numpy(), rest["tokens"].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            if batch is None:
                cuts.append(len(rest))
            found: list[tuple[int, int]] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                many = int(np.searchsorted(outer[s:e], 1))
                if 0 < many < e - s:
                    found += _links_in_unit(ids[s:e], tokens[s:e], many, join)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
            rest = rest.iloc[cuts[-1] :]

    rows = units.join(sets, "id").repartition(*unit).sortWithinPartitions(*unit, "outer")
    return materialise(rows.mapInPandas(compare, "a long, b long"))


def _link_to_heads(posted: _Posted, join: Join) -> DataFrame:
    """Links between the head of each token list, the member that most lists hold, and the list's other members."""
    held = materialise(posted.lists.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held")))
    lists = posted.lists.join(held, "doc_id")
    heads = materialise(lists.groupBy("token").agg(F.max_by("doc_id", F.struct("held", -F.col("doc_id"))).alias("hub")))
    met = posted.lists.join(heads, "token").where("doc_id <> hub")
    met = met.groupBy("hub", F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("shared"), F.min("matches").alias("asked"))
    met = materialise(met.where("2 * shared >= asked").select("hub", "id"))
    of = lambda name, n: posted.sizes.select(F.col("doc_id").alias(name), F.col("n").alias(n))
    near = F.greatest("n", "of_hub") * join.numerator <= F.least("n", "of_hub") * join.denominator
    outer = materialise(met.join(of("id", "n"), "id").join(of("hub", "of_hub"), "hub").where(near))
    inner = outer.select("hub", F.col("hub").alias("id"), F.col("of_hub").alias("n")).distinct()
    return _linked(inner, outer.select("hub", "id", "n"), posted.docs, join)


def _pairs_of_components(lists: DataFrame, join: Join) -> DataFrame:
    """``component_a, component_b`` where the prefixes of two components share as many tokens as two linked sets of theirs would.

    A linked pair shares as many prefix tokens as one of both asks for at least, in the short part of the smaller
    set's prefix; two components share no fewer tokens than any two of their sets. Each token that a linked pair
    shares leaves room for its overlap: what both share before it is in lists of several components
    (``lists`` holds no others), and after it each has only the rest of its set.
    """
    both = join.numerator + join.denominator
    large = F.ceil(2 * join.numerator * F.col("n") / both)
    lists = lists.withColumns({"short": F.col("place") < F.col("n") - large + F.col("matches"), "after": F.col("n") - F.col("place") - 1})
    lists = lists.withColumn("before", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).cast("long") - 1)
    ends = [F.bool_or("short").alias("short"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("matches").alias("least")]
    groups = materialise(lists.groupBy("token", "component").agg(*ends, F.max("before").alias("before"), F.max("after").alias("after")))
    of = lambda s: groups.select("token", *(F.col(c).alias(f"{c}_{s}") for c in groups.columns[1:]))
    like = (F.col("low_b") * join.numerator <= F.col("high_a") * join.denominator) & (F.col("low_a") * join.numerator <= F.col("high_b") * join.denominator)
    able = F.when(F.col("low_a") > F.col("high_b"), F.col("short_b")).when(F.col("low_b") > F.col("high_a"), F.col("short_a"))
    able = able.otherwise(F.col("short_a") | F.col("short_b"))
    room = F.least("before_a", "before_b") + 1 + F.least("after_a", "after_b")
    fits = room * both >= (F.col("low_a") + F.col("low_b")) * join.numerator
    met = of("a").join(of("b"), "token").where((F.col("component_a") < F.col("component_b")) & like & able & fits)
    met = met.groupBy("component_a", "component_b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("least_a", "least_b")).alias("asked"))
    return materialise(met.where("shared >= asked").select("component_a", "component_b"))


def _link_components(lists: DataFrame, posted: _Posted, join: Join) -> DataFrame:
    """Links between sets of different components that may hold some, by ``lists`` with sizes ``n``; of two components the larger one is the hub."""
    members = materialise(lists.select("component", F.col("doc_id").alias("id"), "n").distinct())
    pairs = _pairs_of_components(lists, join)
    number = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    sized = lambda s: number.select(F.col("component").alias(f"component_{s}"), F.struct("members", F.col("component").alias("hub")).alias(s))
    pairs = pairs.join(sized("a"), "component_a").join(sized("b"), "component_b")
    pairs = materialise(pairs.select(F.greatest("a", "b")["hub"].alias("hub"), F.least("a", "b")["hub"].alias("component")))
    outer = materialise(pairs.join(members, "component").select("hub", "id", "n"))
    inner = pairs.select("hub").distinct().join(members, F.col("hub") == F.col("component")).select("hub", "id", "n")
    return _linked(materialise(inner), outer, posted.docs, join)


def ngram_join(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``.

    A document's set holds the 64-bit hashes of its distinct shingles of lowered words
    (fewer words: one shingle). Equal sets form a class, named by its smallest id; links are sought between
    classes. Without words, or with null text, a document links with nothing; with a null id it has no component.
    Rows that share an id are one document; an empty table gives an empty one; other columns are not read.

    Every set is ordered by estimated frequency, so passages that many documents share
    come last, and its prefix is posted, lengthened as its estimated candidates ask. First each list offers its
    members for a link to its head, the member that most lists hold (an original rather than one of its edited
    copies), and whatever verified links connect is not compared again. Then components whose prefixes share as many
    tokens as a linked pair would are compared set by set, in blocks. Against sets that are not smaller a shorter prefix suffices, so of a
    pair's common tokens those count that the smaller set holds there. No list is cut, and no pair within a component is made.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if join.slots is None:
        join = replace(join, slots=counters_for(docs.count()))
    posted = _post(docs, join)
    links = _link_to_heads(posted, join)
    found = connected_components(links)
    placed = found.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    lists = materialise(posted.lists.join(placed, "doc_id", "left").withColumn("component", F.coalesce("c", "component")).drop("c"))
    several = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    several = materialise(several.select("token"))
    if not several.isEmpty():
        more = _link_components(materialise(lists.join(several, "token").join(posted.sizes, "doc_id")), posted, join)
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))
    out = posted.rows.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), known(F.coalesce("component", "class_id", "doc_id")).alias("component_id"), known(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` less the near duplicates, with all their columns: of every component the rows with the smallest id stay.

    Rows without words link with nothing and stay, as do rows with a null id.
    """
    gone = ngram_join(docs, join).where("doc_id <> component_id").select("doc_id")
    return without(docs, "doc_id", materialise(gone))
