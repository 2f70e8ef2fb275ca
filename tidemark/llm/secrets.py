"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams: what a text must hold
for the rule to match at all. Texts are indexed block by block (a block is a few MB of
whole texts in one task): postings say which texts of the block hold each trigram that
any rule asks for. Intersecting and uniting postings gives the candidates of a rule, and
its expression then verifies them. Rules without mandatory trigrams scan all texts.
Postings live and end with their block, so that nothing is shuffled.

The index folds A-Z to lower case. Null text counts as empty and has no spans; repeated
rows repeat their results. Spans are in code points, the end exclusive, sorted by start,
then by the order of the rules; a rule's matches are leftmost and don't overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as ops  # the names of parsed operations
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .words import LOWER


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules, then well-known formats of keys.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # from the left end of a run of its characters: each place of a run would be tried to the run's end otherwise
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)

#: Alternatives that a derivation follows exactly; beyond, a part counts as unknown.
EXACT = 128

# A query is None (any text), or ("and" | "or", parts), or a trigram (three bytes).


def _and(a, b):
    return b if a is None else a if b is None or a == b else ("and", (a, b))


def _or(a, b):
    return None if a is None or b is None else a if a == b else ("or", (a, b))


def _holds(strings: set[bytes]):
    """Query for texts that hold one of the strings."""
    least = {s for s in strings if not any(o != s and o in s for o in strings)}  # a string that holds another adds nothing
    if not least or min(map(len, least)) < 3:
        return None
    return reduce(_or, [reduce(_and, [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(least)])


def _set_members(items) -> set[bytes] | None:
    found = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(value)
        elif op is ops.RANGE and value[1] - value[0] < 16:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    return {chr(c).lower().encode() for c in found} if len(found) <= 16 and max(found) < 128 else None


def _derived(nodes) -> tuple[set[bytes] | None, object]:
    """(all strings that match, or None if not known; query) of a sequence of parsed operations."""
    run, query, exact = {b""}, None, True
    for op, value in nodes:
        own, needs = None, None
        if op is ops.LITERAL and value < 128:
            own = {chr(value).lower().encode()}
        elif op is ops.IN:
            own = _set_members(value)
        elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            own = {b""}
        elif op is ops.SUBPATTERN:
            own, needs = _derived(value[3])
        elif op is ops.BRANCH:
            found = [_derived(x) for x in value[1]]
            if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= EXACT:
                own = set().union(*[e for e, _ in found])
            else:
                needs = reduce(_or, [q if e is None else _holds(e) for e, q in found])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            inner, needs = _derived(value[2])
            if value[:2] == (0, 1) and inner is not None:
                own, needs = inner | {b""}, None
            elif value[0] == 0:
                needs = None
            elif inner is not None:
                needs = _holds(inner)
        if own is not None and len(run) * len(own) <= EXACT:
            run = {a + b for a in run for b in own}
            continue
        exact = False
        query = _and(query, _holds(run))
        query = _and(query, _holds(own) if own is not None else needs)
        run = own if own is not None else {b""}
    return (run, None) if exact else (None, _and(query, _holds(run)))


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every match of pattern satisfies."""
    exact, query = _derived(parser.parse(pattern))
    return _holds(exact) if exact is not None else query


def trigrams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of a block of texts for the given trigrams."""

    def __init__(self, texts: list[str | None], wanted: dict[int, int], table: np.ndarray):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer((b"\n".join(raw) + b"\n\n").translate(LOWER), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw])
        codes = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        at = np.flatnonzero(table[codes])
        pairs = np.unique(codes[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        code, text = np.divmod(pairs, len(texts))
        first = np.searchsorted(code, list(wanted))
        last = np.searchsorted(code, list(wanted), "right")
        self.postings = {c: text[a:b] for c, a, b in zip(wanted, first, last, strict=True)}

    def find(self, query) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[int.from_bytes(query)]
        join = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(join, map(self.find, query[1]))


class Scanner:
    """Rules with their queries; spans of a block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.wanted = dict.fromkeys(sorted(int.from_bytes(t) for _, _, q in self.rules for t in trigrams_of(q)), 0)
        self.table = np.zeros(1 << 24, bool)
        self.table[list(self.wanted)] = True

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        if not texts:
            return []
        index = TrigramIndex(texts, self.wanted, self.table)
        for place, (rule, pattern, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else index.find(query).tolist():
                for m in pattern.finditer(texts[i] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), place, rule.kind, m.end()))
        return [[(kind, start, end) for start, _, kind, end in sorted(x)] for x in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id and spans, an array of (kind, start, end)."""
    span = T.StructType.fromDDL("kind string, start long, end long")
    fields = T.StructType([T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made: list[Scanner] = []

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        if not made:
            made.append(Scanner(rules))  # once a task
        spans = made[0].spans(texts)
        return {"spans": pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], arrow)}

    return map_texts(docs, [id_col], text_col, fields, run)
