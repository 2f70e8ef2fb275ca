"""Best-fit packing of documents into sequences of several permitted lengths.

A document's words are cut into pieces of the longest permitted length, which fill a bin
each, and a rest. Rests are dealt by a hash into groups of about GROUP, each of
which is packed by itself: rests go longest first into the open bin that they leave the
least room in (of several, the one filled last). If none fits, a bin is opened: every permitted length that fits is tried
with the rests still to come, and the one is opened whose sequence, cut down to what it
would hold, costs least a word. At last each bin is cut down to the shortest permitted length
that holds its contents. A group leaves a few bins that are not full, whatever the number
of groups.

Null and empty texts have one row of length 0 and no bin. Every row is packed for itself,
also rows that repeat an id; those that repeat id and text are dealt over the groups. Empty tables give empty results, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, words_in

#: Permitted sequence lengths in words.
LENGTHS = (512, 1024, 2048, 4096)
#: Rests that one group packs, on average.
GROUP = 4_096


def sequence_cost(length: int) -> float:
    """What a sequence costs: a fixed part, one by the word, and one by the pair of words."""
    return 64 + length + length * length / 8192


def best_fit(rests: list[int], lengths: Sequence[int], costs: Sequence[float]) -> tuple[list[int], list[int]]:
    """Bin of each rest (given longest first, all from 1 to the greatest length), and each bin's length."""
    bins, used, capacity = [], [], []
    room: dict[int, list[int]] = {}  # bins by what is left in them
    free = 0  # bit r is set if a bin has r left
    left = [0] * (max(lengths) + 1)
    for r in rests:
        left[r] += 1
    coming = sum(1 << r for r, n in enumerate(left) if n)  # bit r is set if a rest of r is still to be packed

    def filled(size: int, length: int) -> int:
        """Words that a bin of this length would hold: size, and the longest rests that fit, one after another."""
        taken: dict[int, int] = {}
        gap, mask = length - size, coming
        while gap > 0:
            r = (mask & ((2 << gap) - 1)).bit_length() - 1
            if r < 1:
                break
            n = min(gap // r, left[r])
            taken[r] = n
            gap -= n * r
            mask &= ~(1 << r)
        return length - gap

    for r in rests:
        left[r] -= 1
        if not left[r]:
            coming &= ~(1 << r)
        fits = free >> r
        if fits:
            gap = r + (fits & -fits).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                free &= ~(1 << gap)
        else:
            best = None
            for length in lengths:
                if length >= r:
                    holds = filled(r, length)
                    price = min(c for x, c in zip(lengths, costs, strict=True) if x >= holds) / holds
                    if best is None or price < best[0]:
                        best = (price, length)
            b, gap = len(used), best[1]
            used.append(0)
            capacity.append(gap)
        bins.append(b)
        used[b] += r
        if gap > r:
            room.setdefault(gap - r, []).append(b)
            free |= 1 << (gap - r)
    return bins, [min(x for x in lengths if x >= u) for u in used]


_OUT = "piece long, start long, length long, bin_id string, bin_length long, bin_used long, bin_start long"


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per piece of a row of docs: its id, piece, start and length in words; bin_id, bin_length, bin_used; bin_start, the piece's place in its bin."""
    lengths = sorted(lengths)
    costs, most = [sequence_cost(x) for x in lengths], lengths[-1]
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), words_in(F.col(f"`{text_col}`")).alias("__size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__hash"))
    rows = stored(rows, "lengths")
    groups = max(1, -(-rows.filter("__size > 0").count() // group))
    # rows that repeat id and text are counted, and their number is dealt over the groups, from that of their hash on
    counted = rows.filter("__size > 0").groupBy("__id", "__size", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("__n"), F.lit(groups)) - 1)).alias("__step")
    dealt = counted.select("*", step).withColumns(
        {"__group": F.pmod(F.pmod("__hash", F.lit(groups)) + F.col("__step"), F.lit(groups)), "__n": F.expr(f"(__n - __step + {groups - 1}) div {groups}")}
    )
    schema = T.StructType([T.StructField(id_col, rows.schema["__id"].dataType), *T.StructType.fromDDL(_OUT).fields])
    arrow = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__size", "ascending"), ("__id", "ascending"), ("__hash", "ascending")])
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table.column("__n").to_numpy())))
        sizes, name = table.column("__size").to_pylist(), table.column("__group")[0].as_py()
        order = sorted((i for i, n in enumerate(sizes) if n % most), key=lambda i: -(sizes[i] % most))
        bins, ends = best_fit([sizes[i] % most for i in order], lengths, costs)
        fill = [0] * len(ends)
        for i, b in zip(order, bins, strict=True):
            fill[b] += sizes[i] % most
        place, at = [0] * len(ends), dict(zip(order, bins, strict=True))
        of, out = [], []
        full = len(ends)
        for i, n in enumerate(sizes):
            for piece in range(n // most):
                of.append(i)
                out.append((piece, piece * most, most, f"{name}:{full}", most, most, 0))
                full += 1
            if i in at:
                b, piece, rest = at[i], n // most, n % most
                of.append(i)
                out.append((piece, piece * most, rest, f"{name}:{b}", ends[b], fill[b], place[b]))
                place[b] += rest
        ids = table.column("__id").take(pa.array(of, pa.int64()))
        return pa.table([ids, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)]], names=schema.names)

    some = dealt.groupBy("__group").applyInArrow(pack, schema)
    zero, none = F.lit(0).cast("long"), F.lit(None)
    empty = rows.filter("__size = 0").select(F.col("__id").alias(id_col), zero, zero, zero, none.cast("string"), none.cast("long"), none.cast("long"), none.cast("long"))
    return some.union(empty)
