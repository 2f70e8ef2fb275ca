"""Cumulative counters to deltas, rates and interval means.

First samples differ by operator and are kept apart on purpose: their absolute value
(delta_first_absolute), zero (delta_max_gap), or a baseline of zero (interval_mean,
interval_failures). `order` must tell a key's samples apart, ties included.

A null counter gives a null result, and is no baseline: the next sample is held against the
last one that was not null, and against its time.

ranges: cuts keys that hold a large part of all samples into ranges of time (see `running`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket
from ..schemas import Family
from .running import running


def _seen(value: str, seen: Column | str | None = None) -> Column:
    """A value in rows where `seen` (itself if None) is not null."""
    seen = F.col(value) if seen is None else seen
    return F.when(seen.isNotNull(), F.col(value))


def _at_least_0(value: Column) -> Column:
    """Not greatest(), which skips nulls."""
    return F.when(value < 0, F.lit(0)).otherwise(value)


def delta_first_absolute(df: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], gauges: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Counters to their growth since the key's last sample, at least 0; a first sample gives its value. Gauges stay."""
    rows = running(df, keys, order, before={f"__{c}": F.col(c) for c in counters}, ranges=ranges)
    grown = [F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(_at_least_0(F.col(c) - F.col(f"__{c}"))).alias(c) for c in counters]
    return rows.select(*keys, *[c for c in order if c not in keys], *grown, *gauges)


def family_deltas(df: DataFrame, family: Family, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """delta_first_absolute of a family's own counters; its gauges stay."""
    kinds = {m.name: m.kind for m in family.metrics}
    grown = [n for n, k in kinds.items() if k == "counter"]
    return delta_first_absolute(df, keys, order, grown, [n for n in kinds if n not in grown], ranges)


def delta_max_gap(df: DataFrame, keys: Sequence[str], time: str, counter: str, max_gap: int = 15_000, tiebreak: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds `delta`: growth at least 0 since the last sample if that is at most max_gap old; 0 else, and for a first sample."""
    own = F.col(counter)
    rows = running(df, keys, [time, *tiebreak], before={"__value": own, "__time": _seen(time, own)}, ranges=ranges)
    near = F.col(time) - F.col("__time") <= max_gap
    delta = F.when(own.isNull(), F.lit(None)).when(near, _at_least_0(own - F.col("__value"))).otherwise(F.lit(0))
    return rows.withColumn("delta", delta).drop("__value", "__time")


def interval_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], total_time: str, total_count: str, negative: str = "zero", ranges: int | None = None) -> DataFrame:
    """Adds `mean`: time per operation since the last sample, from a baseline of 0. 0 without new operations; negative: 'zero' also where the count fell, 'keep' not.

    A sample is one of both counters: null if either is.
    """
    both = F.col(total_time) + F.col(total_count)
    rows = running(df, keys, order, before={"__time": _seen(total_time, both), "__count": _seen(total_count, both)}, ranges=ranges)
    time, count = (F.col(c) - F.coalesce(b, F.lit(0)) for c, b in ((total_time, "__time"), (total_count, "__count")))
    none = {"zero": count <= 0, "keep": count == 0}[negative]
    mean = F.when(both.isNull(), F.lit(None)).when(none, F.lit(0.0)).otherwise(F.try_divide(time, count).cast("double"))
    return rows.withColumn("mean", mean).drop("__time", "__count")


def interval_failures(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: str, clamp: bool = True, ranges: int | None = None) -> DataFrame:
    """Adds `failures`: growth since the last sample from a baseline of 0; clamp: at least 0."""
    rows = running(df, keys, order, before={"__failed": F.col(failed)}, ranges=ranges)
    grown = F.col(failed) - F.coalesce("__failed", F.lit(0))
    return rows.withColumn("failures", _at_least_0(grown) if clamp else grown).drop("__failed")


def counter_rate(df: DataFrame, keys: Sequence[str], time: str, tiebreak: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Network counters to a row each for `in` and `out`: packets, drops and bits per second since the last sample. First samples give no rows.

    Columns: in_packets, in_delivers, in_bytes, out_packets, out_discards, out_no_routes, out_bytes.
    A sample is one of all of them: where one is null, its rows hold nulls and it is no baseline.
    """
    names = ("in_packets", "in_delivers", "in_bytes", "out_packets", "out_discards", "out_no_routes", "out_bytes")
    whole = sum((F.col(c) * 0 for c in names), F.lit(0))
    rows = running(df, keys, [time, *tiebreak], before={f"__{c}": _seen(c, whole) for c in (time, *names)}, ranges=ranges)
    columns = {f"__{time}": F.col(time) - F.col(f"__{time}")} | {f"__{c}": F.col(c) + whole - F.col(f"__{c}") for c in names}
    rows = rows.withColumns(columns).filter(F.col(f"__{time}").isNotNull())

    def rate(delta: Column, scale: int = 1) -> Column:
        return F.try_divide(1000 * scale * delta, F.col(f"__{time}")).cast("double")

    def side(name: str, drops: Column) -> Column:
        return F.struct(F.lit(name).alias("direction"), rate(F.col(f"__{name}_packets")).alias("packets"), rate(drops).alias("drops"), rate(F.col(f"__{name}_bytes"), 8).alias("bits"))

    both = F.array(side("in", F.col("__in_packets") - F.col("__in_delivers")), side("out", F.col("__out_discards") + F.col("__out_no_routes")))
    return rows.select(*keys, time, *tiebreak, F.inline(both))


#: Measures of a TCP flow.
FLOW_MEASURES = ("tx_queue", "rx_queue", "lost", "send_cwnd", "ssthresh")


def flow_means(flows: DataFrame, keys: Sequence[str] = ("dest",), measures: Sequence[str] = FLOW_MEASURES) -> DataFrame:
    """Per destination: number of flows, and each measure's total divided by it."""
    n = F.count(F.lit(1))
    return flows.groupBy(*keys).agg(n.alias("flows"), *[F.try_divide(F.sum(m), n).cast("double").alias(m) for m in measures])


def last_sample(df: DataFrame, keys: Sequence[str], time: str, interval_ms: int = 5000, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Of a key's samples in a bucket the latest; adds `bucket`. An aggregate, so that samples combine before the shuffle."""
    rows = df.withColumn("bucket", bucket(F.col(time), interval_ms))
    latest = F.max_by(F.struct(*df.columns), F.struct(time, *tiebreak))
    return rows.groupBy(*keys, "bucket").agg(latest.alias("__s")).select("__s.*", "bucket")
