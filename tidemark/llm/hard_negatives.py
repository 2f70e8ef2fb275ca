"""Hard-negative mining by a secondary sort: scores packed into keys, and windows that open as a sorted stream goes by.

Vectors are whole numbers: floor(SCALE * x) of each component. A score is the inner product with
the anchor. Rows go by score, higher first, then by id. An anchor's positives are its first POSITIVES
other rows of its label. Each positive opens a window: rows of another label with LOW to HIGH per
cent of its score. The first NEGATIVES rows in the window are its hard negatives.

1. Anchors, the stated query set, are dealt into blocks of a bounded size, each of which is broadcast; all
   rows pass by it in batches, each a product of two matrices.
2. First pass: of each batch the best rows of an anchor's own label; combined, its positives.
3. Second pass: of each batch, the first rows of another label in each positive's window. What is left out
   has as many better ones in its own batch, so that the result is whole, and what is shuffled
   grows with batches, not with pairs.
4. Secondary sort: key (anchor, descending score, kind, id) as bytes whose order is that of the key.
   repartitionAndSortWithinPartitions deals by anchor and sorts within a partition. A task walks its sorted keys once.
   A positive opens a window; a negative goes to the windows that it is in. Held are an anchor's open
   windows alone, never its rows.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of unequal
lengths are compared by what both have. Repeated ids are rows of their own: an anchor's copy is another row, and each anchor row gives its own
results; ties beyond the id go by the row's number. An anchor without positives or negatives gives no rows. Scores beyond
64 bits end the job with an error. Empty tables give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Components of a block of anchors; and of a step of rows, with the scores that it gives.
BLOCK, STEP = 1 << 24, 1 << 22


class Anchors(NamedTuple):
    """A block: the anchors' rows, ids and labels, and their vectors as a matrix."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Whole numbers as doubles, shorter vectors filled with 0; what is beyond width is left out."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs, exactly: as doubles where no sum leaves 53 bits, else with whole numbers of any size."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in a] for a in anchors], object).reshape(anchors.shape) @ np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape).T
    if any(abs(int(x)) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("scores leave 64 bits")
    return exact.astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row, id, label, vector (whole numbers as doubles) of rows that take part, written, so that a row keeps its number."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    given = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    # not floor() as it gives longs, which large components leave
    down = lambda x: F.when(F.abs(x * scale) >= 2.0**52, x * scale).otherwise(F.floor(x * scale).cast("double"))
    return stored(whole.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", down).alias("vector")), "vectors")


def _block(rows: DataFrame) -> Anchors:
    """Anchors of a block, in order of id and row. Its size is bounded by the caller."""
    held = rows.toArrow().sort_by([("id", "ascending"), ("row", "ascending")])
    return Anchors(*(held.column(c).to_numpy() for c in ("row", "id", "label")), _matrix(held.column("vector")))


class Tile(NamedTuple):
    """Rows of a batch in order of id and row, and their scores with the anchors [first, first + len(score))."""

    id: np.ndarray
    row: np.ndarray
    label: np.ndarray
    first: int
    score: np.ndarray


def _tiles(batch: pa.RecordBatch, anchors: Anchors) -> Iterator[Tile]:
    part = pa.table(batch).sort_by([("id", "ascending"), ("row", "ascending")])
    columns = [part.column(c).to_numpy() for c in ("id", "row", "label")]
    vectors = _matrix(part.column("vector"), anchors.vectors.shape[1])
    size = max(1, STEP // max(1, batch.num_rows))
    for at in range(0, len(anchors.row), size):
        yield Tile(*columns, at, scores(anchors.vectors[at : at + size], vectors))


def _first(score: np.ndarray, inside: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first n places of each row of a matrix that are inside, by score, then from left to right."""
    # places below the n-th score of a row go before the sort
    held = np.where(inside, score, np.iinfo(np.int64).min)
    if score.shape[1] > n:
        least = np.partition(held, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        inside = inside & (held >= least[:, None])
    row, column = np.nonzero(inside)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < n], column[nth < n]


_PAIRS = "anchor bigint, anchor_row bigint, id bigint, row bigint, score bigint"


def _pairs(anchors: Anchors, t: Tile, a: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    """Of a tile's anchors a with its rows r."""
    of = a + t.first
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors.id[of], anchors.row[of], t.id[r], t.row[r], t.score[a, r])], [f.split()[0] for f in _PAIRS.split(", ")])


def positives(rows: DataFrame, block: Anchors, n: int = POSITIVES) -> DataFrame:
    """anchor, anchor_row, id, row, score: the first n other rows of each anchor's label."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*shared.value)
        for batch in batches:
            for t in _tiles(batch, anchors):
                own = slice(t.first, t.first + len(t.score))
                a, r = _first(t.score, (anchors.label[own, None] == t.label) & (anchors.row[own, None] != t.row), n)
                yield _pairs(anchors, t, a, r)

    best = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "id", "row")
    found = rows.mapInArrow(run, T.StructType.fromDDL(_PAIRS))
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n).drop("nth")


def candidates(rows: DataFrame, block: Anchors, positive: pa.Table, n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor, anchor_row, id, row, score: of each batch, the first n rows of another label in the window of each positive."""
    of = np.argsort(block.row)
    anchor = of[np.searchsorted(block.row[of], positive.column("anchor_row").to_numpy())]
    shared = rows.sparkSession.sparkContext.broadcast((tuple(block), anchor, positive.column("score").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchor, wanted = shared.value
        anchors = Anchors(*held)
        # equal windows of an anchor count once, and one of each anchor at a time
        windows = np.unique(np.stack([anchor, wanted], axis=1), axis=0)
        turn = np.arange(len(windows)) - np.searchsorted(windows[:, 0], windows[:, 0])
        for batch in batches:
            for t in _tiles(batch, anchors):
                other = anchors.label[t.first : t.first + len(t.score), None] != t.label
                low_end, high_end = np.searchsorted(windows[:, 0], [t.first, t.first + len(t.score)])
                found = [np.zeros((0, 2), np.int64)]
                for k in range(int(turn.max(initial=-1)) + 1):
                    a, w = windows[low_end:high_end][turn[low_end:high_end] == k].T
                    a = a - t.first
                    r, c = _first(t.score[a], other[a] & _inside(w[:, None], t.score[a], low, high), n)
                    found.append(np.stack([a[r], c], axis=1))
                yield _pairs(anchors, t, *np.unique(np.concatenate(found), axis=0).T)

    return rows.mapInArrow(run, T.StructType.fromDDL(_PAIRS))


def _inside(positive: np.ndarray, score: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, in bounds of the score, so that no product leaves 64 bits."""
    least = [-((-low * int(p)) // 100) for p in positive.ravel()]
    most = [high * int(p) // 100 for p in positive.ravel()]
    ends = [np.clip(np.array(x, object), -(1 << 63), (1 << 63) - 1).astype(np.int64).reshape(positive.shape) for x in (least, most)]
    return (score >= ends[0]) & (score <= ends[1])


#: Anchor, its row, descending score, kind (0 for a positive, so that its window is open for equal scores), id, row.
_KEY = struct.Struct(">QQQBQQ")
_SIGN = 1 << 63


def packed_key(anchor: int, anchor_row: int, score: int, kind: int, key: int, row: int) -> bytes:
    """Bytes that sort by anchor, then higher scores first, then positives first, then by id and row."""
    return _KEY.pack(anchor + _SIGN, anchor_row, _SIGN - 1 - score, kind, key + _SIGN, row)


def walked(keys: Iterable[bytes], n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from sorted keys; an anchor's open windows are all that is held."""
    current, windows = None, []  # windows: [positive, score, negatives so far]
    for packed in keys:
        anchor, anchor_row, score, kind, key, _ = _KEY.unpack(packed)
        if (anchor, anchor_row) != current:
            current, windows = (anchor, anchor_row), []
        score = _SIGN - 1 - score
        if kind == 0:
            windows.append([key - _SIGN, score, 0])
            continue
        # scores fall: a window that is full or left behind takes no more
        windows = [w for w in windows if w[2] < n and 100 * score >= low * w[1]]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor - _SIGN, w[0], w[2], key - _SIGN, w[1], score


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are anchors, a condition on the column id; high: 100 at most, so that windows open before their negatives come."""
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high are per cent, low not above high")
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, label if isinstance(label, Column) else F.col(f"`{label}`"), scale)
    wanted = rows.filter(anchor)
    n, width = wanted.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, width) // block))
    parts = None
    for k in range(blocks):
        own = _block(wanted.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k))
        found = stored(positives(rows, own, n_positives), "positives")
        near = candidates(rows, own, found.toArrow(), n_negatives, low, high)
        both = found.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
        parts = both if parts is None else parts.unionByName(both)

    def key(r: T.Row) -> tuple[bytes, None]:
        return packed_key(r.anchor, r.anchor_row, r.score, r.kind, r.id, r.row), None

    def sorted_walk(part: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        return walked((k for k, _ in part), n_negatives, low, high)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.rdd.map(key).repartitionAndSortWithinPartitions(partitions, lambda k: portable_hash(k[:16]))
    schema = T.StructType.fromDDL("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return spark.createDataFrame(dealt.mapPartitions(sorted_walk), schema, verifySchema=False)
