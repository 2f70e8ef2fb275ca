"""Benchmark decontamination: an FM-index per shard of training documents, which test phrases are searched in.

A word is a run of digits, letters and characters beyond ASCII; A-Z count as a-z. A phrase is
WINDOW consecutive words of a benchmark item, or all words of a shorter one. Words of a document
inside an occurrence of a phrase are hit.

1. The benchmark is dealt into blocks of at most about BLOCK words, the stated query set. A block is
   broadcast and all documents pass by it, without a shuffle: the text goes through tasks as it is read.
2. A task takes shards of whole documents. A word that no phrase of the block has is in no
   occurrence: it parts the text, and parts shorter than the shortest phrase are left out. (A filter
   alone: what is left is indexed and searched.)
3. Of a shard's parts an FM-index is built. All phrases move through it by backward search, a word at
   a time, with ranks in a wavelet matrix; those whose interval of rows is empty drop out.
4. The rows of the intervals are located by walking to the next row whose position is kept, of which
   there is one every SAMPLE words.
5. Occurrences of all phrases are merged into removal spans of each document.

Null texts have no words, documents without words no hits, items without words no phrases. Rows that
repeat an id are rows of their own; items that repeat an id are one item. A null item id hits as any
other and counts as an item with an empty name. Empty tables give empty results, or no hits. A
document is held whole by its task: its bytes, four bytes a word, and what could be in a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, stored
from .fm_index import PhraseIndex
from .words import LOWER

#: Words of a phrase.
WINDOW = 10
#: Words of a block of the benchmark, about; bytes of text of a shard, and of what is split into words at a time.
BLOCK, SHARD_BYTES, PIECE = 1 << 20, 8 << 20, 8 << 20
#: A word of lower-cased text.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(ITEM_WORD)
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Lower case for A-Z, a space for all that is in no word; the end of a text is a word of its own, which no text holds.
_TABLE = bytes(LOWER[b] if chr(LOWER[b]).isalnum() or b > 127 else 32 for b in range(256))
_END = b"\x00"

_SPANS = "spans array<struct<start:int,end:int,from:int,to:int>>"


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class Phrases(NamedTuple):
    """Of a block: numbers of its words, from 1 on; phrases by length as arrays of numbers; the items of each phrase."""

    vocabulary: dict[bytes, int]
    phrases: list[np.ndarray]
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p in self.phrases), default=0)


def phrases_of(ids: list[str | None], texts: list[str | None], window: int) -> Phrases:
    """Phrases of items, each once. Phrase k (of all lengths in a row) has the items items[item_starts[k]:item_starts[k+1]]."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({i or "" for i in ids})
    number = {n: k for k, n in enumerate(names)}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for key, text in zip(ids, texts, strict=True):
        words = [vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in item_words(text)]
        size = min(window, len(words))
        found = by_length.setdefault(size, {})
        for at in range(len(words) - size + 1 if size else 0):
            found.setdefault(tuple(words[at : at + size]), set()).add(number[key or ""])
    by_length.pop(0, None)
    owners = [sorted(o) for found in by_length.values() for o in found.values()]
    starts = np.zeros(len(owners) + 1, np.int64)
    np.cumsum([len(o) for o in owners], out=starts[1:])
    return Phrases(vocabulary, [np.array(list(found), np.int64) for found in by_length.values()], starts, np.array([i for o in owners for i in o], np.int64), names)


def _numbered(raw: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of all texts as numbers, 0 for those not in the vocabulary, and -1 at the end of each text."""
    joined = b"".join(x for t in raw for x in (t.translate(_TABLE), b" \x00 "))
    known = vocabulary | {_END: -1}
    out, at = [], 0
    while at < len(joined):
        end = at + PIECE
        if end < len(joined):  # not within a word
            end = joined.find(b" ", end)
            end = len(joined) if end < 0 else end
        words = joined[at:end].split()
        out.append(np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class Hits(NamedTuple):
    """Per document its words; of all documents the runs of hit words, as (document, first, end), and the (document, phrase) that occur."""

    n_words: np.ndarray
    runs: np.ndarray
    found: np.ndarray


def shard_hits(raw: list[bytes], block: Phrases) -> Hits:
    """Where the phrases of a block occur in the texts of a shard (UTF-8)."""
    codes = _numbered(raw, block.vocabulary)
    ends = np.flatnonzero(codes == -1)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    nothing = Hits(ends - begins, np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64))
    if not block.phrases:
        return nothing
    start, end = _runs(codes > 0)
    long = end - start >= block.shortest
    start, end = start[long], end[long]
    if not len(start):
        return nothing
    size = end - start
    # words of a part, one after another, each part followed by a gap
    flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)
    index = PhraseIndex(codes[flat].astype(np.int64), size)
    first, places, phrases, lengths = 0, [], [], []
    for group in block.phrases:
        phrase, at = index.find(group)
        places.append(flat[at])
        phrases.append(phrase + first)
        lengths.append(np.full(len(at), group.shape[1]))
        first += len(group)
    place, phrase, length = (np.concatenate(x) for x in (places, phrases, lengths))
    if not len(place):
        return nothing
    cover = np.zeros(len(codes) + 1, np.int32)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + length, -1)
    run_start, run_end = _runs(np.cumsum(cover[:-1]) > 0)  # an occurrence lies within a document, and ends before its end mark
    document = np.searchsorted(ends, run_start)
    runs = np.stack([document, run_start - begins[document], run_end - begins[document]], axis=1)
    pairs = np.unique(np.stack([np.searchsorted(ends, place), phrase], axis=1), axis=0)
    return Hits(ends - begins, runs, pairs)


def _merged(old: list[dict], new: list[tuple[int, int]], text: str) -> list[dict]:
    """Word ranges of both, merged, with the code points that they take in the text."""
    ranges = sorted([(s["start"], s["end"]) for s in old] + new)
    out: list[list[int]] = []
    for s, e in ranges:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    if not out:
        return []
    wanted, places = {x for s, e in out for x in (s, e - 1)}, {}
    for k, m in enumerate(_WORD.finditer(text.translate(_LOWER))):
        if k in wanted:
            places[k] = m.span()
            if k == out[-1][1] - 1:
                break
    return [{"start": s, "end": e, "from": places[s][0], "to": places[e - 1][1]} for s, e in out]


def _pass(rows: DataFrame, block: Phrases) -> DataFrame:
    """From (id, text, n_words, spans, items): the same, with what the block adds."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(block))
    schema = rows.schema
    spans_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "from", "to")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Phrases(*shared.value)
        for batch in batches:
            for part in steps(batch, 1, SHARD_BYTES):
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                hits = shard_hits(raw, own)
                spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
                for d, of in _by_first(hits.runs):
                    spans[d] = _merged(spans[d], [(int(s), int(e)) for s, e in of], raw[d].decode())
                for d, of in _by_first(hits.found):
                    numbers = np.unique(np.concatenate([own.items[own.item_starts[p] : own.item_starts[p + 1]] for p in of[:, 0]]))
                    items[d] = sorted({*items[d], *(own.names[i] for i in numbers)})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hits.n_words), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], schema.names)

    return rows.mapInArrow(run, schema)


def _by_first(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows in order of their first column: each value of it, and the rest of its rows."""
    cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
    for group in np.split(rows, cuts) if len(rows) else []:
        yield int(group[0, 0]), group[:, 1:]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, keep_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, spans (hit words [start, end), in code points [from, to)), items (ids of items with occurring phrases, sorted); with keep_text also text."""
    items = stored(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct(), "items")
    # a word takes a byte and a separator at least
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"CAST(array() AS {_SPANS.split(' ', 1)[1]})").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        if k:
            rows = stored(rows, "decontamination")
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        rows = _pass(rows, phrases_of(own.column("item").to_pylist(), own.column("text").to_pylist(), window))
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "items", *["text"] * keep_text)


def n_hit(spans: Column | str) -> Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row of docs: id, the text without its removal spans, n_removed (words). Texts without hits stay as they are."""
    found = contamination(docs, benchmark, id_col, text_col, keep_text=True, **how)
    state = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "spans", state,
        lambda a, s: F.struct(F.concat(a["kept"], F.substr(F.col("text"), a["at"] + 1, s["from"] - a["at"])).alias("kept"), s["to"].alias("at")),
        lambda a: F.concat(a["kept"], F.substr(F.col("text"), a["at"] + 1)),
    )
    return found.select(F.col(f"`{id_col}`"), F.when(F.size("spans") > 0, cut).otherwise(F.col("text")).alias(text_col), n_hit("spans").alias("n_removed"))
