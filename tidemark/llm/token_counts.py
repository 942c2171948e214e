"""Token counts of byte-level BPE by prefix dynamic programming over pieces of text."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashing import Spans, mix
from tidemark.tables import text_batches

#: Fixed value: how byte-level BPE splits a text into pieces before merging.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed value: the same split for texts of ASCII, Latin-1 and Latin Extended-A/B alone, whose letters and digits are listed.
_SIMPLE = re.compile("[\\x00-\\x84\\x86-\\x9f\\xa1-\\u024f\\u2018-\\u201d\\u2013\\u2014\\u2026]*")
_L, _N = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_S = "\\x09-\\x0d\\x20"
_PIECES_SIMPLE = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SPACES = regex.compile(r"\s*")
#: Pieces of more bytes are counted one by one rather than in a block.
LONG = 48
#: Pieces a Python worker remembers; when full it starts anew.
REMEMBERED = 800_000


def split_pieces(text: str) -> list[str]:
    """The pieces of ``text``, by the faster of two equal patterns."""
    return (_PIECES_SIMPLE if _SIMPLE.fullmatch(text) else PIECES).findall(text)


class Lookup:
    """A hash table from 64-bit keys to int32 values in numpy arrays; -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes, todo, at = 0, np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):
            self.probes += 1
            slot, first = np.unique(at[todo], return_index=True)
            free = self.values[slot] < 0
            won = todo[first[free]]
            self.keys[slot[free]], self.values[slot[free]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        held = self.values[at]
        out = np.where(self.keys[at] == keys, held, -1)
        todo = np.flatnonzero((out < 0) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            held = self.values[at[todo]]
            out[todo] = np.where(self.keys[at[todo]] == keys[todo], held, -1)
            todo = todo[(out[todo] < 0) & (held >= 0)]
        return out


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


class Bpe:
    """The vocabulary and merges of a byte-level BPE file, ready for prefix counting."""

    def __init__(self, path: str):
        held = json.load(open(path, encoding="utf-8"))
        vocab, merges = held["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        self.special = [t["content"] for t in held["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        # token numbers of our own: bytes, then merges by rank
        number = {s: b for s, b in byte.items()}
        left, right, raw = list(range(256)), list(range(256)), [bytes([b]) for b in range(256)]
        for a, b in merges:
            if a + b in vocab and a + b not in number:
                number[a + b] = len(raw)
                left.append(number[a])
                right.append(number[b])
                raw.append(raw[number[a]] + raw[number[b]])
        self.left, self.right, self.raw = np.array(left), np.array(right), raw
        self.token = {r: i for i, r in enumerate(raw)}
        made = np.arange(256, len(raw))
        self.merged = Lookup(_pair_key(self.left[made], self.right[made]), made.astype(np.int32))
        self.merge = {(left[i], right[i]): i for i in range(256, len(raw))}
        self.longest = max(map(len, raw))
        size = np.array([len(r) for r in raw])
        ends = np.cumsum(size)
        self.tokens = Lookup(Spans(np.frombuffer(b"".join(raw), np.uint8)).of(ends - size, ends), np.arange(len(raw), dtype=np.int32))
        self.known: dict[str, int] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves token ``a`` followed by ``b`` as they are.

        Undo the later of the two tokens step by step; a merge across the border that
        ranks before the undone ones would have come first.
        """
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            across = self.merged(_pair_key(a, b)).astype(np.int64)
            bad = (across >= 0) & (across < limit)
            ok[live[bad]] = False
            later = a > b
            atom = np.where(later, a, b) < 256
            go = ~bad & ~atom
            live, a, b, limit, later = live[go], a[go], b[go], limit[go], later[go]
            # what stands right of the border wins a tie in rank only if it comes first
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def _fits(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            across = self.merge.get((a, b), -1)
            if 0 <= across < limit:
                return False
            if max(a, b) < 256:
                return True
            if a > b:
                limit, a = a, int(self.right[a])
            else:
                limit, b = b + 1, int(self.left[b])

    def prefixes(self, raw: bytes) -> list[int]:
        """Tokens of every prefix of one piece: entry i counts ``raw[:i]``."""
        last, count = [-1], [0]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                t = self.token.get(raw[start:end])
                if t is not None and (start == 0 or self._fits(last[start], t)):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
        return count

    def block(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece (LONG bytes at most), all pieces at once: one step for each prefix length."""
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)
        at = np.cumsum(size) - size
        spans = Spans(data)
        most = int(size[0])
        last, count = np.full((most + 1, len(pieces)), -1, np.int32), np.zeros((most + 1, len(pieces)), np.int32)
        for end in range(1, most + 1):
            n = int(np.searchsorted(-size, -end, side="right"))
            open_ = np.arange(n)
            for start in range(max(0, end - self.longest), end):
                t = self.tokens(spans.of(at[open_] + start, at[open_] + end))
                found = np.flatnonzero(t >= 0)
                if not len(found):
                    continue
                who = open_[found]
                fits = np.ones(len(who), bool) if start == 0 else self.compatible(last[start, who], t[found])
                who = who[fits]
                last[end, who], count[end, who] = t[found[fits]], count[start, who] + 1
                if len(who):
                    left = np.ones(len(open_), bool)
                    left[found[fits]] = False
                    open_ = open_[left]
                    if not len(open_):
                        break
        out = np.empty(len(pieces), np.int64)
        out[order] = count[size, np.arange(len(pieces))]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Count the pieces not yet known."""
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        raw = [p.encode() for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        for i, r in enumerate(raw):
            if len(r) > LONG:
                self.known[new[i]] = self.prefixes(r)[-1]
        for k in range(0, len(short), 1 << 16):
            part = short[k : k + (1 << 16)]
            for i, n in zip(part, self.block([raw[i] for i in part]).tolist(), strict=True):
                self.known[new[i]] = n

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """``text`` split at special tokens, and whether each part is one."""
        if not any(s in text for s in self.special):
            return [(text, False)]
        return [(x, x in self.special) for x in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if x]

    def prefix_counts(self, texts: Iterable[str | None]) -> Iterator[PrefixCounts]:
        """The prefix counts of each whole text; pieces new to this worker are counted in blocks."""
        for group in _grouped(texts):
            split = [[(x, special, [x] if special else split_pieces(x)) for x, special in self.parts(t or "")] for t in group]
            self.learn({p for parts in split for _, special, pieces in parts if not special for p in pieces})
            for t, parts in zip(group, split, strict=True):
                yield PrefixCounts(t or "", parts, self)

    def of_prefix(self, text: str) -> int:
        """Tokens of a short text without special tokens."""
        return sum(self.prefixes(p.encode())[-1] for p in PIECES.findall(text))

    def piece_prefixes(self, piece: str) -> list[int]:
        """Tokens of the first i code points of a piece, for every i."""
        by_byte = self.prefixes(piece.encode())
        if regex.fullmatch(r"'(?:ll|ve|re)", piece):
            return [0, *(self.of_prefix(piece[:i]) for i in (1, 2)), by_byte[-1]]
        return [by_byte[n] for n in accumulate((len(c.encode()) for c in piece), initial=0)]


def _grouped(texts: Iterable[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


class PrefixCounts:
    """Exact token counts of every prefix of one text, kept as running sums over its pieces.

    ``before`` holds the tokens before each piece and ``total`` those of all; a prefix that ends inside a piece adds that
    piece's own prefix counts. So cuts and budgets are answered by look-ups, and the text is never encoded again. What a cut leaves may
    split in other pieces than the whole text at two places: a run of white space before a word becomes one piece, and
    a special token that is cut becomes ordinary text.
    """

    def __init__(self, text: str, parts: list[tuple[str, bool, list[str]]], bpe: Bpe):
        self.text, self.bpe = text, bpe
        self.inside: dict[tuple[int, int], list[int]] = {}
        self.pieces = [p for _, _, pieces in parts for p in pieces]
        self.special = {k for k, s in enumerate(s for _, s, pieces in parts for _ in pieces) if s} if bpe.special and any(s for _, s, _ in parts) else set()
        known = bpe.known
        self.before = list(accumulate((1 if k in self.special else known[p] for k, p in enumerate(self.pieces)) if self.special else map(known.__getitem__, self.pieces), initial=0))
        self.total = self.before[-1]

    @cached_property
    def starts(self) -> list[int]:
        return list(accumulate(map(len, self.pieces), initial=0))

    def _within(self, start: int, end: int) -> list[int]:
        """The prefix counts of a stretch that is one piece, counted once."""
        if (start, end) not in self.inside:
            self.inside[start, end] = self.bpe.piece_prefixes(self.text[start:end])
        return self.inside[start, end]

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points, as encoding just those would give."""
        chars = max(0, min(chars, len(self.text)))
        k = bisect_right(self.starts, chars) - 1
        if chars == self.starts[k] and not (k and k < len(self.pieces) and self.text[chars - 1].isspace()):
            return self.before[k]
        low = chars
        while low and self.text[low - 1].isspace():
            low -= 1
        if chars - low > 1:  # the run of white space ends here now
            j = bisect_right(self.starts, low) - 1
            if self.starts[j] == low and j not in self.special:
                end = _SPACES.match(self.text, low).end()
                if end >= chars:
                    return self.before[j] + self._within(low, end)[chars - low]
        if chars == self.starts[k]:
            return self.before[k]
        if k not in self.special:
            return self.before[k] + self._within(self.starts[k], self.starts[k + 1])[chars - self.starts[k]]
        if k and k - 1 not in self.special:  # the beginning of a special token may join the piece before it
            k -= 1
        return self.before[k] + self.bpe.of_prefix(self.text[self.starts[k] : chars])

    def cut(self, tokens: int) -> int:
        """The most code points, up to the end of the first piece that overflows the budget, whose tokens fit it."""
        if self.total <= tokens:
            return len(self.text)
        k = bisect_right(self.before, tokens) - 1  # pieces before k fit
        k = next((j for j in range(k, len(self.pieces)) if self.before[j + 1] > tokens), k)
        start, end = self.starts[k], self.starts[k + 1]
        if k in self.special:
            return next((c for c in range(end, start, -1) if self.at(c) <= tokens), start)
        inside = self._within(start, end)
        fits = next((i for i in range(len(inside) - 1, 1, -1) if self.before[k] + inside[i] <= tokens), 0)
        return start + (fits or int(self.at(start + 1) <= tokens))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit, chars_in_limit`` for whole texts.

    ``chars_in_limit`` is how many code points of the text fit ``limit`` tokens, from its prefix counts. Null counts as empty (0 of
    all); rows that repeat an id, and those of null id, are counted one by one; an empty table gives an empty one; other columns are
    not read. A map over the rows: no shuffle, one batch of texts and a bounded memory of pieces at a time.
    """
    out = prefix_counts(docs, vocabulary, [limit], id_col, text_col)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("cuts")[limit].alias("chars_in_limit"))


def prefix_counts(docs: DataFrame, vocabulary: str, budgets: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the code points that fit each budget: ``doc_id, n_bytes, n_tokens, cuts map<int,int>``; no text is encoded twice."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            n, cuts = np.zeros(len(batch), np.int64), []
            for i, held in enumerate(bpe.prefix_counts(batch["t"])):
                n[i] = held.total
                cuts.append({b: held.cut(b) for b in budgets})
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "cuts": cuts})

    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return slim.mapInPandas(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, cuts map<int,int>")
