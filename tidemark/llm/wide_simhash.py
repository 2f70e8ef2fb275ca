"""Near-copies by multi-index hashing of wide SimHash fingerprints: five words a shingle, a similarity of 0.8 or more.

A fingerprint has BITS bits. A bit is 1 if it is set in over half the hashes of the text's word shingles, each of which counts once,
after A-Z became lower case; a shingle's hash is its XXH64 (seed 42), mixed again and again for the bits beyond 64. Two
texts whose shingles have a Jaccard similarity of 0.8 differ in 78 of 512 bits on average, give or take 8, texts of 0.7 in 98, of 0.6 in 118.
Those that differ in MAX_BITS at most are linked.

The first bits are cut into SEGMENTS segments of WIDTH bits. Every fingerprint stands in a table under each of its
segments. It looks up a small Hamming ball around each: the segment itself and those with one or two of its WEAK
least certain bits turned. Bits whose counts are close to half differ first between near-copies, so that this ball of 16
finds most of what a ball of all bits would. Whole distances are verified in each bucket that is hit, and a bucket
gives a spanning forest of its links. One that near-copies fill is one tree after a few comparisons, and
costs no more than its length then.

Recall is that of a filter: see the README for figures. Text with fewer words than a shingle has its
whole sequence as the only shingle, one with none (null, empty) the fingerprint zero. Of each component one
row stays, that with the smallest id, null ids last; of those the one with the smallest hash of its columns.
Rows that repeat in all columns are one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, row_hash, stored
from .simhash import bit_counts, components, linked_labels, shingle_hashes
from .words import LOWER, split_words

SHINGLE, SEGMENTS, WIDTH, WEAK = 5, 12, 26, 5
#: Bits of a fingerprint, and in how many of them linked ones may differ.
BITS, MAX_BITS = 512, 88
#: Which of the WEAK bits a lookup turns: none, one or two.
_TURNS = [(), *combinations(range(WEAK), 1), *combinations(range(WEAK), 2)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another number of 64 bits for each, by the finaliser of XXH64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(14029467366897019727)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(1609587929392839161)
    return x ^ (x >> np.uint64(32))


def wide_prints(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its fingerprint (bytes of bits, lowest first) and the WEAK least certain bits of each segment, the least certain first."""
    text, hashes = shingle_hashes(split_words(texts, LOWER), shingle)
    # a shingle that repeats in a text counts once
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    once = np.ones(len(text), bool)
    once[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    lanes = [hashes[once]]
    with np.errstate(over="ignore"):
        while 64 * len(lanes) < BITS:
            lanes.append(_mixed(lanes[-1] + np.uint64(0x9E3779B97F4A7C15)))
    n, counts = bit_counts(text[once], np.stack(lanes, axis=1).view(np.uint8), len(texts))
    margin = np.abs(2 * counts - n[:, None])[:, : SEGMENTS * WIDTH].reshape(len(texts), SEGMENTS, WIDTH)
    weak = np.argsort(margin, axis=2, kind="stable")[:, :, :WEAK].astype(np.uint8)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little"), weak.reshape(len(texts), SEGMENTS * WEAK)


def lookups(prints: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Keys (segment and its value) by fingerprint, segment and turn; turn 0 is the segment itself."""
    bits = np.unpackbits(prints[:, : SEGMENTS * WIDTH // 8], axis=1, bitorder="little").reshape(len(prints), SEGMENTS, WIDTH)
    value = (bits.astype(np.int64) << np.arange(WIDTH)).sum(axis=2)
    turned = np.int64(1) << weak.reshape(len(prints), SEGMENTS, WEAK).astype(np.int64)
    masks = np.stack([sum((turned[:, :, i] for i in t), np.zeros_like(value)) for t in _TURNS], axis=2)
    return (value[:, :, None] ^ masks) | (np.arange(SEGMENTS, dtype=np.int64) << WIDTH)[None, :, None]


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(-1, BITS // 64)


def bucket_forest(prints: np.ndarray, members: int, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (places) among the fingerprints of a bucket, of which the first `members` stand in it and the others look it up.

    A member is compared with all. As soon as all are one component, the rest needs no comparison.
    """
    label, at, block = np.arange(len(prints)), 0, 1
    while at < members:
        own = prints[at : at + block]
        apart = np.bitwise_count(own[:, None, :] ^ prints[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(apart <= most)
        label = linked_labels(label, i + at, j)
        if not label.any():
            break
        at += len(own)
        block = min(2 * block, max(1, (1 << 20) // len(prints)))
    far = np.flatnonzero(label != np.arange(len(prints)))
    return far, label[far]


def _forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (key, looks, nid, fp), sorted by key and looks: links (a, b) of nids. Holds one bucket at a time."""
    held: list[pa.RecordBatch] = []
    current = None

    def links() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nid, members = table.column("nid").to_numpy(), table.num_rows - int(table.column("looks").to_numpy().sum())
        a, b = bucket_forest(_words(table.column("fp").to_pylist()), members, most)
        return pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], ["a", "b"])

    for batch in batches:
        key = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                if current is not None and key[s] != current:
                    yield links()
                    held.clear()
                current = key[s]
                held.append(batch.slice(s, e - s))
    if held:
        yield links()


def _keys(prints: DataFrame, own: bool) -> DataFrame:
    """From (nid, root, fp, weak): (key, nid, root) of the segments themselves, or of the turned ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bits, weak = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("fp", "weak"))
                found = lookups(bits, weak)
                found = found[:, :, :1] if own else found[:, :, 1:]
                nid, root = (np.repeat(part.column(c).to_numpy(), found.shape[1] * found.shape[2]) for c in ("nid", "root"))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(nid), pa.array(root)], ["key", "nid", "root"])

    return prints.select("nid", "root", "fp", "weak").mapInArrow(run, "key bigint, nid bigint, root bigint")


def _compared(rows: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """From (key, looks, nid): the links of each bucket. Trees begin at their smallest nid, so that the buckets of a class give the same links mostly."""
    rows = rows.join(first.select("nid", "fp"), "nid").select("key", "looks", "nid", "fp")
    return rows.repartition("key").sortWithinPartitions("key", "looks", "nid").mapInArrow(lambda batches: _forests(batches, most), "a bigint, b bigint").distinct()


def near_links(first: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """From distinct fingerprints (nid, fp, weak): links (a, b) of nids, which connect those that are found to differ in `most` bits at most.

    First those that share a segment are linked, which brings the members of a large class together. Of the lookups only those
    count then that lead to another component than the fingerprint's own.
    """
    alone = first.withColumn("root", F.col("nid"))
    members = _keys(alone, True)
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    links = stored(_compared(members.join(shared, "key", "left_semi").withColumn("looks", F.lit(0)), first, most), "links")
    roots = components(links).select(F.col("fp").alias("nid"), "root")
    rooted = stored(first.join(roots, "nid", "left").select("nid", "fp", "weak", F.coalesce("root", "nid").alias("root")), "rooted")
    members = _keys(rooted, True)
    filled = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumnRenamed("key", "at")
    elsewhere = (F.col("key") == F.col("at")) & ((F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root")))
    hits = stored(_keys(rooted, False).join(filled, elsewhere, "left_semi").select("key", "nid"), "hits")
    rows = members.select("key", "nid").join(hits.select("key").distinct(), "key", "left_semi").withColumn("looks", F.lit(0)).union(hits.withColumn("looks", F.lit(1)))
    return links.union(_compared(rows.select("key", "looks", "nid"), first, most))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """One row of each component of near-copies, with all its columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sha, rest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), row_hash(docs)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), sha.alias("sha"), rest.alias("rest"), F.col(f"`{text_col}`").alias("text"))
    fields = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("weak", T.BinaryType())])

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        return {n: pa.array([row.tobytes() for row in x], pa.binary()) for n, x in zip(("fp", "weak"), wide_prints(texts, shingle), strict=True)}

    prints = stored(map_texts(named, ["id", "sha", "rest"], "text", fields, run), "prints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rest", "sha")).alias("best")
    # a number that stays with its fingerprint once it is written
    first = stored(prints.groupBy("fp").agg(best, F.min("weak").alias("weak")).withColumn("nid", F.monotonically_increasing_id()), "first")
    roots = components(near_links(first, most)).withColumnRenamed("fp", "nid")
    won = first.join(roots, "nid", "left").groupBy(F.coalesce("root", "nid").alias("root")).agg(F.min("best").alias("best")).select("best.sha", "best.rest")
    rows = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), sha.alias("sha"), rest.alias("rest")).join(won, ["sha", "rest"], "left_semi")
    # rows that repeat in all columns combine within tasks
    once = rows.groupBy("sha", "rest").agg(F.first("row").alias("row"))
    return once.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
