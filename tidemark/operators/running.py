"""Values that run along a key's rows: what came before, what comes next, sums so far.

A window holds all rows of a key in one task, in order. `ranges` deals them otherwise, for keys
with a large part of all rows:

1. Rows are partitioned by ranges of (key, order), as a sort would, so that a hot key's time line is cut into as many
   ranges as its rows need. They are written once, each with its range.
2. Each range sums up what it has of each key: its last values, its sums, its first values. What a range takes over from those
   before (or after) it is a window over these summaries: a row per key and range.
3. A window by (range, key) runs within ranges, and begins with what was taken over.

`cut` names a column of ranges that rows have already, as of a file that is read by parts, or from `in_ranges` for several passes
along one order: nothing is written then.

Results are the same either way. Rows of a key must differ in `order`; nulls come first, and null keys are one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored_table


#: The column of ranges that `in_ranges` adds.
CUT = "__range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """Rows with the number of their range of (key, order), written once. Later passes take it as `cut`, along this order or one that agrees with it."""
    return stored_table(df.repartitionByRange(ranges, *keys, *order).withColumn(CUT, F.spark_partition_id()), "ranges")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: Mapping[str, Column] | None = None, upto: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, most: Mapping[str, Column] | None = None, ranges: int | None = None, cut: str | None = None,
) -> DataFrame:
    """Adds columns, along the rows of each key in order.

    before: the last value that is not null in rows before. upto: the same, the row itself included. after: the
    next row's value, null or not. sums, most: sum and largest of values so far, the row itself included; for sums nulls count as 0.
    """
    named = [("before", n, c) for n, c in (before or {}).items()] + [("upto", n, c) for n, c in (upto or {}).items()]
    named += [("after", n, c) for n, c in (after or {}).items()] + [("sums", n, c) for n, c in (sums or {}).items()] + [("most", n, c) for n, c in (most or {}).items()]
    given = df.columns
    rows = df.withColumns({f"__v{i}": c for i, (_, _, c) in enumerate(named)})
    by, taken = list(keys), {}
    if ranges is not None:
        rows, cut = in_ranges(rows, keys, order, ranges), CUT
    if cut is not None:
        by = [cut, *keys]
        rows, taken = _with_taken(rows, keys, order, named, cut)
    along = Window.partitionBy(*by).orderBy(*order)
    made = {n: _along(kind, F.col(f"__v{i}"), along, taken.get(i)) for i, (kind, n, _) in enumerate(named)}
    return rows.select(*[F.col(f"`{c}`") for c in given if c not in made], *[c.alias(n) for n, c in made.items()])


def _along(kind: str, value: Column, along: Window, taken: Column | None) -> Column:
    if kind == "after":
        found = F.lead(F.struct(value.alias("v"))).over(along)
        return (found if taken is None else F.coalesce(found, taken))["v"]
    if kind == "sums":
        found = F.coalesce(F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        return found if taken is None else found + F.coalesce(taken, F.lit(0))
    if kind == "most":
        found = F.max(value).over(along.rowsBetween(Window.unboundedPreceding, 0))
        return found if taken is None else F.greatest(found, taken)
    found = F.last(value, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1 if kind == "before" else 0))
    return found if taken is None else F.coalesce(found, taken)


def _with_taken(rows: DataFrame, keys: Sequence[str], order: Sequence[str], named: Sequence[tuple[str, str, Column]], cut: str) -> tuple[DataFrame, dict[int, Column]]:
    """Rows with what their range takes over from others, by number of the value."""
    at, summaries, takes = F.struct(*order), [], []
    along = Window.partitionBy(*[f"__k{j}" for j in range(len(keys))]).orderBy("__own")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    for i, (kind, _, _) in enumerate(named):
        v, s = F.col(f"__v{i}"), F.col(f"__s{i}")
        if kind == "after":
            summaries.append(F.min_by(F.struct(v.alias("v")), at).alias(f"__s{i}"))
            takes.append(F.lead(s).over(along).alias(f"__t{i}"))
        elif kind == "sums":
            summaries.append(F.sum(v).alias(f"__s{i}"))
            takes.append(F.sum(s).over(earlier).alias(f"__t{i}"))
        elif kind == "most":
            summaries.append(F.max(v).alias(f"__s{i}"))
            takes.append(F.max(s).over(earlier).alias(f"__t{i}"))
        else:
            summaries.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"__s{i}"))
            takes.append(F.last(s, ignorenulls=True).over(earlier).alias(f"__t{i}"))
    found = rows.groupBy(F.col(cut).alias("__own"), *[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)]).agg(*summaries)
    found = found.select("__own", *[f"__k{j}" for j in range(len(keys))], *takes)
    # most keys lie in one range and take over nothing
    some = F.lit(False)
    for i in range(len(named)):
        some |= F.col(f"__t{i}").isNotNull()
    same = F.col(cut) == F.col("__own")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{j}"))
    return rows.join(found.filter(some), same, "left"), {i: F.col(f"__t{i}") for i in range(len(named))}
