"""Secret scans: regex rules narrowed by a trigram inverted index, then verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from re import _constants as op, _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashing import slices
from tidemark.tables import text_batches

#: Most strings one stretch of a regex may stand for before it counts as unknown.
MOST = 64
#: A Boolean trigram query: True, or ("and" | "or", queries), or a trigram.
Query = bool | bytes | tuple


def both(*queries: Query) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(*queries: Query) -> Query:
    parts = list(dict.fromkeys(queries))
    if any(q is True for q in parts):
        return True
    asked = [(q, frozenset(q[1] if isinstance(q, tuple) and q[0] == "and" else [q])) for q in parts]
    least = [q for q, own in asked if not any(other < own for _, other in asked)]  # a query that implies another adds nothing
    return least[0] if len(least) == 1 else ("or", tuple(least))


def _of_strings(strings: set[bytes]) -> Query:
    if any(len(s) < 3 for s in strings):
        return True
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _members(items: list) -> set[bytes] | None:
    found: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(bytes([value]).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST:
            found |= {bytes([c]).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 16 else None


def _walk(nodes) -> tuple[set[bytes] | None, Query]:
    """The strings that ``nodes`` match exactly, if few, and else what every match holds."""
    run, query, exact = {b""}, True, True

    def unknown() -> None:
        nonlocal run, query, exact
        query, run, exact = both(query, _of_strings(run)), {b""}, False

    for kind, value in nodes:
        strings: set[bytes] | None = None
        inner: Query = True
        if kind is op.LITERAL:
            strings = {bytes([value]).lower()}
        elif kind is op.IN:
            strings = _members(value)
        elif kind is op.AT:
            strings = {b""}
        elif kind is op.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif kind is op.BRANCH:
            ways = [_walk(way) for way in value[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            else:
                inner = either(*(both(q, _of_strings(s)) if s is not None else q for s, q in ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            own, within = _walk(body)
            if own is not None and (least, most) == (0, 1):
                strings = own | {b""}
            elif own is not None and least == most and len(own) ** least <= MOST:
                strings = reduce(lambda a, _, own=own: {x + y for x in a for y in own}, range(least), {b""})
            elif least:
                inner = both(within, _of_strings(own)) if own is not None else within
        if strings is not None and len(strings) * len(run) <= MOST:
            run = {a + b for a in run for b in strings}
        else:
            unknown()
            query = both(query, inner)
            if strings is not None:
                query = both(query, _of_strings(strings))
    return (run, True) if exact else (None, both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """What the lowered trigrams of a text must fulfil for ``pattern`` to match in it; True if nothing must."""
    strings, query = _walk(parser.parse(pattern.encode()))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern over ASCII, and the least length of the group that decides."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode())

    def find(self, raw: bytes) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(raw) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base rules first, then further ones that only add spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


class Segment:
    """Postings of the trigrams that the rules ask for, over one run of texts."""

    def __init__(self, run: list[bytes], wanted: dict[bytes, int], table: np.ndarray):
        self.run, self.wanted = run, wanted
        data = np.frombuffer(b"\n".join(run) + b"\n\n\n", np.uint8)
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
        number = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(number)
        starts = np.cumsum([0, *(len(x) + 1 for x in run)])[:-1]
        found = np.unique(number[at].astype(np.int64) * len(run) + np.searchsorted(starts, at, side="right") - 1)
        cuts = np.searchsorted(found, np.arange(len(wanted) + 2) * len(run))
        self.postings = {t: found[cuts[i] : cuts[i + 1]] - i * len(run) for t, i in wanted.items()}

    def texts(self, query: Query) -> np.ndarray:
        """The texts that fulfil ``query``: all of them where it asks for nothing."""
        if query is True:
            return np.arange(len(self.run))
        if isinstance(query, bytes):
            return self.postings[query]
        parts = sorted(map(self.texts, query[1]), key=len)
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, spans array<struct<kind,start,end>>`` in code points, end exclusive, over whole texts.

    Each task indexes its texts in segments of a quarter of a megabyte: for every trigram some
    rule needs, the texts that hold it. A rule's Boolean query intersects and unites postings; only
    its candidates run the regex. A rule without mandatory trigrams (``hex``) scans every text. Spans are
    leftmost and do not overlap within a kind, ordered by start, then by rule. Null counts as
    empty and has no spans; rows that repeat an id, and those of null id, are scanned one by one; an empty table gives an empty one; other columns
    are not read. Nothing shuffles; postings live as long as their segment.
    """
    order = {r.kind: i for i, r in enumerate(rules)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = {t: i + 1 for i, t in enumerate(sorted(set().union(*(trigrams_of(r.query) for r in rules))))}
        table = np.zeros(1 << 24, np.uint16)
        for t, i in wanted.items():
            table[int.from_bytes(t)] = i
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for first, run in slices(batch["t"].tolist()):
                segment = Segment(run, wanted, table)
                hits: dict[int, list[tuple[int, int, int]]] = {}
                for rule in rules:
                    for i in segment.texts(rule.query).tolist():
                        if found := rule.find(run[i]):
                            hits.setdefault(i, []).extend((s, order[rule.kind], e) for s, e in found)
                for i, found in hits.items():
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(run[i], np.uint8) & 0xC0) != 0x80)))
                    out[first + i] = [{"kind": rules[k].kind, "start": int(points[s]), "end": int(points[e])} for s, k, e in sorted(found)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    text_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return slim.mapInPandas(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
