"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashing import Spans, mix, slices
from tidemark.llm.memory import release, released
from tidemark.llm.token_counts import Lookup
from tidemark.tables import text_batches

#: Bytes by which longer pieces are sought only where their beginning fits.
STEM = 6
#: Bytes of texts that are sampled at once.
RUN = 1 << 16
#: Spaces of a run that a chunk holds at most; the longest piece of spaces has 16 in the public models.
BLANKS = 64
#: Arcs of chunk lattices that a task remembers (about 16 bytes each); when there are more it starts anew.
ARCS = 1 << 18


class _Lattices:
    """The lattices of the chunks met so far, one after another, found by a hash of the chunk.

    Node ``at + i`` of a chunk is the place after its first i bytes; the arcs into node n are those from
    ``first[n]`` on, and ``source, piece, upto`` describe an arc.
    """

    def __init__(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.nodes, self.arcs = np.zeros(1 << 16, np.int32), 0, 0
        self.data = np.zeros(1 << 16, np.uint8)
        self.source, self.piece, self.upto = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32), np.zeros(1 << 17)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The node where each chunk starts; -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.at[at], -1)

    def add(self, keys: np.ndarray, start: np.ndarray, data: np.ndarray, source: np.ndarray, piece: np.ndarray, upto: np.ndarray, first: np.ndarray) -> None:
        nodes, arcs = self.nodes + len(data), self.arcs + len(source)
        self.data, self.first = _grown(self.data, nodes), _grown(self.first, nodes + 2)
        self.source, self.piece, self.upto = (_grown(x, arcs) for x in (self.source, self.piece, self.upto))
        self.data[self.nodes : nodes] = data
        self.first[self.nodes + 2 : nodes + 2] = first[2:] + self.arcs
        self.source[self.arcs : arcs] = source + self.nodes
        self.piece[self.arcs : arcs], self.upto[self.arcs : arcs] = piece, upto
        keys, at = np.concatenate((self.keys, keys)), np.concatenate((self.at, (start + self.nodes).astype(np.int32)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.nodes, self.arcs = keys[order], at[order], nodes, arcs


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


class Pieces:
    """The pieces of a SentencePiece model as a lattice vocabulary over bytes.

    The meta symbol for a space is the space byte here, so that a meta symbol in a text is an
    ordinary character, written as byte pieces. A piece's weight follows Zipf's
    law in its rank by score (a merge model's scores are ranks, not probabilities). Pieces of spaces, and of a word after spaces, are all in the lattice. A
    piece that holds a space after other characters (the public models have none) is never drawn, since chunks end before a run of spaces; decoding knows them all.
    """

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        n = held.vocab_size()
        self.byte_id = np.full(256, -1, np.int32)
        self.raw: list[bytes] = [b""] * n
        usual = []
        for i in range(n):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i)):
                self.raw[i] = piece.replace("▁", " ").encode()
                if b" " not in self.raw[i].lstrip(b" "):
                    usual.append(i)
        usual.sort(key=lambda i: (-held.get_score(i), i))
        self.weight = np.full(n, -np.inf)
        rank = np.arange(len(usual)) + 2.0
        self.weight[usual] = -np.log(rank) - np.log((1 / rank).sum())
        self.byte_weight = float(self.weight[usual].min())
        raw = [self.raw[i] for i in usual]
        size = np.array([len(r) for r in raw])
        ends = np.cumsum(size)
        spans = Spans(np.frombuffer(b"".join(raw), np.uint8))
        self.lookup = Lookup(spans.of(ends - size, ends), np.array(usual, np.int32))
        self.sizes = np.unique(size)
        starts = (ends - size)[size > STEM]
        stems = np.unique(spans.of(starts, starts + STEM))
        self.stems = Lookup(stems, np.zeros(len(stems), np.int32))
        self.border = np.zeros(256, bool)
        self.border[[c for c in range(32) if not any(c in r for r in raw)]] = True
        self.size = np.array([len(r) for r in self.raw])
        self.offset = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.known, self.alpha = _Lattices(), None

    def lattice(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, alpha: float) -> tuple[np.ndarray, ...]:
        """Arcs into every byte position of the chunks, longest first, with cumulative probabilities.

        ``data`` holds the chunks one after another. Forward filtering sums the
        weights (to the power ``alpha``) of all ways to each position.
        """
        start, size = start.astype(np.int32), size.astype(np.int32)
        end_of = np.repeat(start + size, size)
        spans, places = Spans(data), np.arange(len(data), dtype=np.int32)
        char = (data & 0xC0) != 0x80
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(data), bool)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.int32)
        long_ = None
        for n in map(np.int32, self.sizes):
            at = places[char] if n <= STEM else long_
            if n > STEM and long_ is None:
                at = places[char & (places + STEM <= end_of)]
                at = long_ = at[self.stems(spans.of(at, at + STEM)) >= 0]
            at = at[at + n <= end_of[at]]
            piece = self.lookup(spans.of(at, at + n))
            at, piece = at[piece >= 0], piece[piece >= 0]
            single[at[width[at] == n]] = True
            found.append((at, at + n, piece))
        alone = places[char & ~single]
        found.append((alone, alone + width[alone], np.full(len(alone), -1, np.int32)))
        # longest first into each position: the runs below ascend, which a stable sort merges
        source, target, piece = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(target, kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        weight = alpha * np.where(piece >= 0, self.weight[piece], self.byte_weight * (target - source))
        chunk_start = np.repeat(start, size)
        depth = target - chunk_start[source]
        small = np.uint16 if size.max(initial=0) < 1 << 16 else np.int64
        by_depth = np.argsort(depth.astype(small), kind="stable")
        depth = depth[by_depth]
        total = np.full(len(data) + 1, -np.inf)  # of the position after a byte; where a chunk starts it is 0
        way = np.empty(len(source))
        cuts = np.flatnonzero(np.diff(depth.astype(np.int64), prepend=-1, append=-2))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            arc = by_depth[low:high]
            s, t = source[arc], target[arc]
            value = np.where(s == chunk_start[s], 0.0, total[s]) + weight[arc]
            way[arc] = value
            first = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(value, first)
            length = np.diff(first, append=len(t))
            sums = np.add.reduceat(np.exp(value - np.repeat(top, length)), first)
            # a chunk's end is the next one's start, which counts as 0 above
            total[t[first]] = top + np.log(sums)
        upto = np.exp(way - total[target])
        arcs, more = np.bincount(target, minlength=len(data) + 1), 1
        first = np.concatenate(([0], np.cumsum(arcs)))
        node = np.flatnonzero(arcs > 1)
        while len(node):  # a node's sum never depends on other chunks
            upto[first[node] + more] += upto[first[node] + more - 1]
            more += 1
            node = node[arcs[node] > more]
        upto[first[1:][arcs > 0] - 1] = 2.0
        return source, piece, upto, first

    def sample(self, run: list[bytes], keys: np.ndarray, alpha: float) -> list[np.ndarray]:
        """Piece ids of each text, drawn by numbers that its key and the place in the text decide."""
        data = np.frombuffer(b"".join(b" " + r for r in run), np.uint8)
        text_at = np.cumsum([0, *(len(r) + 1 for r in run)])
        border = self.border[data]
        space = data == 32
        opens = space & np.concatenate(([True], ~space[:-1]))
        opens[text_at[:-1]] = True
        index = np.arange(len(data))
        opens |= space & ((index - np.maximum.accumulate(np.where(opens, index, 0))) % BLANKS == 0)
        opens |= border
        opens[1:] |= border[:-1]
        start = np.flatnonzero(opens)
        size = np.diff(start, append=len(data))
        key, index, back = np.unique(Spans(data).of(start, start + size), return_index=True, return_inverse=True)
        if self.known.arcs > ARCS or self.alpha != alpha:
            self.known, self.alpha = _Lattices(), alpha
        new = np.flatnonzero(self.known.find(key) < 0)
        if len(new):
            own_size = size[index[new]]
            own_start = np.cumsum(own_size) - own_size
            own = data[np.arange(own_size.sum()) + np.repeat(start[index[new]] - own_start, own_size)]
            self.known.add(key[new], own_start, own, *self.lattice(own, own_start, own_size, alpha))
        source, piece, upto, first, own = self.known.source, self.known.piece, self.known.upto, self.known.first, self.known.data
        low = self.known.find(key)[back].astype(np.int64)
        text = np.searchsorted(text_at, start, side="right") - 1
        seed = keys[text]
        place = start - text_at[text]
        live, node = np.arange(len(start)), low + size
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            end = node[live] - low[live] + place[live]
            u = (mix(seed[live] ^ mix(end.astype(np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = first[node[live]]
            late = np.flatnonzero(u >= upto[arc])
            while len(late):
                arc[late] += 1
                late = late[u[late] >= upto[arc[late]]]
            steps.append((live.astype(np.int32), piece[arc], source[arc]))
            node[live] = source[arc]
            live = live[source[arc] > low[live]]
        emits = np.zeros(len(start), np.int64)
        ends = low + size
        for who, p, s in steps:
            emits[who] += np.where(p >= 0, 1, ends[who] - s)
            ends[who] = s
        pointer = np.cumsum(emits)
        out = np.empty(int(pointer[-1]) if len(pointer) else 0, np.int32)
        bounds = np.concatenate(([0], pointer))[np.searchsorted(start, text_at)]
        ends = low + size
        for who, p, s in steps:
            count = np.where(p >= 0, 1, ends[who] - s)
            ends[who] = s
            pointer[who] -= count
            whole = p >= 0
            out[pointer[who[whole]]] = p[whole]
            for j in range(4):
                part = np.flatnonzero(~whole & (count > j))
                out[pointer[who[part]] + j] = self.byte_id[own[s[part] + j]]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a list of ids: its pieces' bytes, less the space that encoding puts first."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offset[ids] - (ends - size), size)].tobytes()[1:]


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model at ``path``, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, key_col: str = "doc_id", text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``ids``, one sampled segmentation of every whole text; null counts as empty.

    A text is cut before every run of spaces (and within one every BLANKS spaces) and around control characters no piece holds; pieces never
    reach over these cuts, so that each chunk has a lattice of its own, which a task remembers for its next
    occurrences. ``alpha`` sharpens the distribution. The same key, seed and text give the same
    ids in any partitioning and order; a null key counts as a value, rows that repeat a key and text get the same ids. An empty
    text is the one space that stands first. An empty table gives an empty one; other columns stay as they are, but one named
    ``out`` is replaced. A map of the rows: nothing shuffles.
    """

    text_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def drawn(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        release()
        pieces = load(model)
        for keys, texts in released(batches):
            hashed, ids = keys.to_numpy().astype(np.int64).view(np.uint64), []
            for first, run in slices(texts.tolist(), RUN):
                ids += pieces.sample(run, hashed[first : first + len(run)], alpha)
            yield pd.Series(ids, dtype=object)
        pieces.known = _Lattices()  # an idle worker holds none
        release()

    return docs.withColumn(out, drawn(F.xxhash64(F.col(key_col), F.lit(seed)), F.coalesce(F.col(text_col), F.lit(""))))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that ``ids`` spell: null for null, the empty text for no ids, as for the one space of an empty text. An empty table gives an empty one."""

    @F.pandas_udf("string")
    def spelt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load(model)
        for ids in released(batches):
            yield pd.Series([None if x is None else pieces.decode(np.asarray(x, np.int64)).decode() for x in ids], dtype=object)

    return rows.withColumn(out, spelt(F.col(ids_col)))
