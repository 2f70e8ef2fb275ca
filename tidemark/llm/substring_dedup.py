"""Removal of repeated passages: a compressed FM-index per shard, and matching statistics of streamed segments.

A window is WINDOW words in a row. Each word of a document goes that is covered by a
window whose words also start somewhere in a document with a smaller id.

1. Every window picks an anchor: of its groups of GRAMS[0] words the one with the least
   hash, the leftmost of equal ones. Equal windows pick equal anchors, and windows in a row mostly
   share theirs, so that a document has an anchor for every 20 words or so. A segment is a
   run of windows of one anchor. Anchors are a filter only: what occurs in one document
   alone needs no search, and windows that could be equal come to one shard.
2. Equal segments combine, by a 128-bit digest; only the document with the smallest id
   keeps its one. Distinct segments are dealt into shards by their anchor.
3. Of each shard's segments an FM-index is built, each segment owned by its document, and all of them are streamed
   against it. Backward search goes on as long as the interval of rows holds a document with a smaller
   id, and widens the interval where it doesn't: the matching statistics of a segment
   against earlier documents. A window is a repeat if and only if its statistic reaches WINDOW.
4. Repeats are a segment's spans, and documents lose the words of their spans.

An anchor with more than CROWD distinct segments (what stands beside a passage that a great part of
all documents share) would not fit a shard. Its segments are cut again by longer groups of words, the
next of GRAMS, and go the same way, until an anchor is a whole window, which has few distinct segments.

Ids are integers; others are refused. Null texts have no words; a null id has no smaller one and is
smaller than none, so its words stay. Rows that repeat an id and a text get equal results; rows that
repeat an id are one document with several texts. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, steps, stored
from .fm_index import FMIndex
from .words import split_words, xxh64_ranges

#: Words of a window, and of the groups that anchors are chosen from, the last of which is a window.
WINDOW, GRAMS = 50, (12, 25, 50)
#: Distinct segments of an anchor up to which they go to one shard.
CROWD = 2_048
#: Windows of a segment, at most.
LONGEST = 256
#: Segments of a shard on average, and queries that are streamed at a time.
SHARD, STREAM = 2_048, 8_192

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def segments_of(texts: list[str | bytes | None], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, number of windows, 16 bytes of digest) of each run of windows with one anchor."""
    words = split_words(texts)
    none = np.zeros(0, np.int64)
    n = len(words.starts)
    if n < window:
        return none, none, none, none, none
    hashed = xxh64_ranges(words.buffer, words.starts, words.ends)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _BASE))
        inverse = np.cumprod(np.full(n, _INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * power)])
        grams = (sums[gram:] - sums[:-gram])[: n - gram + 1] * inverse[: n - gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= _MIX
        grams ^= grams >> np.uint64(32)
    place = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n - window + 1)
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(texts)), sizes)[: n - window + 1]
    start = np.flatnonzero(words.first[1:][text] - np.arange(n - window + 1) >= window)
    if not len(start):
        return none, none, none, none, none
    place, text = place[start], text[start]
    anchor = grams[place]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    # long runs, as of one word over and over, are cut; their parts have one anchor still
    run = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    first = np.flatnonzero(run % LONGEST == 0)
    length = np.diff(np.append(first, len(start)))
    begin = start[first]
    view = memoryview(np.ascontiguousarray(words.buffer))
    cuts = zip(words.starts[begin].tolist(), words.ends[begin + length + window - 2].tolist(), strict=True)
    digest = [hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in cuts]
    return text[first], anchor[first].view(np.int64), begin - words.first[:-1][text[first]], length, digest


_SEGMENT = "anchor bigint,first int,n int,digest binary"


def _listed(texts: list[str | bytes | None], window: int, gram: int) -> pa.Array:
    """The segments of each text."""
    text, anchor, first, n, digest = segments_of(texts, window, gram)
    cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
    columns = [pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(list(digest), pa.binary())]
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, ["anchor", "first", "n", "digest"]))


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """From (id, holder, text): a row per segment with id, holder, anchor, first (its place in the text), n (its windows) and digest."""
    fields = T.StructType.fromDDL(f"found array<struct<{_SEGMENT.replace(' ', ':').replace(',', ', ')}>>")
    return stored(map_texts(docs, ["id", "holder"], "text", fields, lambda texts: {"found": _listed(texts, window, gram)}), "anchors").select("id", "holder", F.inline("found"))


def _compressed(docs: DataFrame) -> DataFrame:
    """id, holder and the text as zstd: what is shuffled of a text is a third of it."""
    fields = T.StructType([T.StructField("packed", T.BinaryType())])

    def run(texts: list[str | bytes | None]) -> dict[str, pa.Array]:
        pack = zstandard.ZstdCompressor(1).compress
        return {"packed": pa.array([pack(t if isinstance(t, bytes) else (t or "").encode()) for t in texts], pa.binary())}

    return map_texts(docs, ["id", "holder"], "text", fields, run)


def _unpacked(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """From (id, packed, runs): the words of each run as a row with id, anchor, digest, crowded, segment."""
    schema = T.StructType.fromDDL("id bigint, anchor bigint, digest binary, crowded boolean, segment binary")
    types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "packed", 1 << 19):
                made: list[tuple] = []
                for key, packed, runs in zip(*(part.column(c).to_pylist() for c in ("id", "packed", "runs")), strict=True):
                    words = _unpacked(packed)
                    made += [(key, r["anchor"], r["digest"], r["crowded"], b" ".join(words[r["first"] : r["first"] + r["n"] + window - 1])) for r in runs]
                columns = zip(*made, strict=True) if made else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return docs.mapInArrow(run, schema)


def _runs(inside: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of places inside begin and end; a run stays in one group."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    held = np.concatenate([[False], inside, [False]])
    start = np.flatnonzero(inside & (~held[:-2] | new))
    end = np.flatnonzero(inside & (~held[2:] | np.append(new[1:], True))) + 1
    return start, end


def shard_spans(segments: list[bytes], ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of each run of a segment's windows that also start in a segment with a smaller id.

    A word that one document alone has is in no repeat. It parts the text, and parts shorter than a window are left out.
    """
    owners = np.unique(ids, return_inverse=True)[1]
    symbols: dict[bytes, int] = {}
    texts = [np.array([symbols.setdefault(w, len(symbols)) for w in s.split(b" ")], np.int64) for s in segments]
    sizes = np.array([len(t) for t in texts])
    flat, segment = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    least, most = np.full(len(symbols), len(ids)), np.full(len(symbols), -1)
    np.minimum.at(least, flat, owners[segment])
    np.maximum.at(most, flat, owners[segment])
    start, end = _runs((least < most)[flat], segment)
    long = end - start >= window
    start, end = start[long], end[long]
    if not len(start):
        return start, start, end
    names = np.unique(np.concatenate([flat[s:e] for s, e in zip(start, end, strict=True)]))
    parts = [np.searchsorted(names, flat[s:e]) + 1 for s, e in zip(start, end, strict=True)]
    owner = owners[segment[start]]
    index = FMIndex(parts, owner, window)
    hit = np.zeros(len(flat), bool)
    for at in range(0, len(parts), STREAM):
        length = index.statistics(parts[at : at + STREAM], owner[at : at + STREAM], window)
        of = np.concatenate([np.arange(s, e) for s, e in zip(start[at : at + STREAM], end[at : at + STREAM], strict=True)])
        hit[of] = length >= window
    begin, stop = _runs(hit, segment)
    first = (np.cumsum(sizes) - sizes)[segment[begin]]
    return segment[begin], begin - first, stop - first


def _searched(cut: DataFrame, window: int, shard: int) -> DataFrame:
    """From (digest, id, anchor, segment): the spans (digest, id, start, end) of words that repeat smaller ids, by a search in each shard."""
    shards = max(1, -(-cut.count() // shard))
    spans = T.StructType.fromDDL("digest binary, id bigint, start int, end int")

    def search(table: pa.Table) -> pa.Table:
        of, start, end = shard_spans(table.column("segment").to_pylist(), table.column("id").to_numpy(), window)
        ends = [pa.array(x.astype(np.int32)) for x in (start, end + window - 1)]
        return pa.table([*[table.column(c).take(pa.array(of)).combine_chunks() for c in ("digest", "id")], *ends], names=spans.names)

    dealt = cut.select("digest", "id", "segment", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(search, spans)


def _spans(docs: DataFrame, window: int, grams: Sequence[int], crowd: int, shard: int) -> DataFrame:
    """From (id, holder, text): id, holder and spans, word ranges [start, end) of runs of windows that smaller ids have; an id and holder may come several times."""
    found = _segments(docs, window, grams[0])
    shared = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("anchor")
    held = stored(found.join(shared, "anchor", "left_semi"), "shared")
    distinct = held.groupBy("digest").agg(F.min(F.struct("id", "holder", "first", "n", "anchor")).alias("s")).select("digest", "s.*")
    distinct = stored(distinct, "distinct")
    least = distinct.select("digest", F.col("id").alias("least"))
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n") + window - 1).alias("end")))
    copies = held.join(least, "digest").filter("id > least").select("id", "holder", whole.alias("spans"))

    seen = distinct.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("seen"))
    crowded = (F.col("seen") > crowd) & F.lit(len(grams) > 1)
    wanted = distinct.join(seen.filter("least < most").select("anchor", crowded.alias("crowded")), "anchor")
    runs = wanted.groupBy("id", "holder").agg(F.collect_list(F.struct("first", "n", "anchor", "digest", "crowded")).alias("runs"))
    # rows that repeat an id and a text give their segments once
    once = _compressed(docs).join(runs, ["id", "holder"]).groupBy("id", "holder").agg(F.first("packed").alias("packed"), F.first("runs").alias("runs"))
    cut = stored(_cut(once, window), "segments")
    inner = _searched(cut.filter("NOT crowded"), window, shard).select("digest", "id", F.array(F.struct("start", "end")).alias("spans"))
    if len(grams) > 1 and not cut.filter("crowded").isEmpty():
        again = cut.filter("crowded").select("id", F.col("digest").alias("holder"), F.col("segment").alias("text"))
        inner = inner.union(_spans(again, window, grams[1:], crowd, shard).select(F.col("holder").alias("digest"), "id", "spans"))
    # one row per segment, whose spans go to its places
    inner = inner.groupBy("digest", "id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    places = held.select("id", "holder", "first", "digest")
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    return copies.union(places.join(inner, ["digest", "id"]).select("id", "holder", moved.alias("spans")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, grams: Sequence[int] = GRAMS, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """From (id, holder, text): id, holder and spans, the word ranges [start, end) that repeat windows of smaller ids. Only documents that have any."""
    if grams[-1] != window:
        raise ValueError("the last of grams must be a window")
    return _spans(docs.filter("id IS NOT NULL"), window, grams, crowd, shard).groupBy("id", "holder").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, **how) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), spans; with keep_text also kept_text."""
    if not isinstance(docs.select(F.col(f"`{id_col}`")).schema[0].dataType, T.IntegralType):
        raise ValueError("ids must be integers")
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("id"), F.xxhash64(key, F.col(f"`{text_col}`")).alias("holder"), F.col(f"`{text_col}`").alias("text"))
    spans = repeated_spans(rows, window, **how)
    joined = _compressed(rows).join(spans, ["id", "holder"], "left")
    extra = [("kept_text", pa.string())] if keep_text else []
    schema = T.StructType.fromDDL(f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept_text string" * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "packed"):
                made = []
                for packed, found in zip(part.column("packed").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words, kept, at = _unpacked(packed), [], 0
                    for s in sorted(found or [], key=lambda s: s["start"]):
                        kept += words[at : s["start"]] if s["start"] > at else []
                        at = max(at, s["end"])
                    kept += words[at:]
                    text = b" ".join(kept)
                    made.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns[:3], part.column("spans").cast(spans_type), *columns[3 : 3 + len(extra)]], schema.names)

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return joined.mapInArrow(run, schema)
