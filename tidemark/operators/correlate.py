"""Alignment to bucket edges, attribution of resources to tasks, and gates.

No join has a condition on ranges alone, which would compare all pairs of a key. Overlaps of tasks and
buckets are equi joins on buckets; what held at a time is carried along a key's time line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, unused
from .counters import last_sample
from .running import running


def _buckets(start: Column, end: Column, interval_ms: int) -> Column:
    """Starts of the buckets that (start, end] meets."""
    return F.sequence(bucket(start, interval_ms), bucket(end - 1, interval_ms), F.lit(interval_ms).cast("long"))


def _overlap(start: Column, end: Column, interval_ms: int) -> Column:
    return F.least(end, F.col("bucket") + interval_ms) - F.greatest(start, F.col("bucket"))


def align_runs(samples: DataFrame, keys: Sequence[str], time: str, value: str, interval_ms: int = 5000, mode: str = "weighted", tiebreak: Sequence[str] = (), max_gap: int | None = None, ranges: int | None = None) -> DataFrame:
    """What align gives, with neighbouring buckets that one sample fills wholly as one row: keys, from_ms, to_ms, value.

    However long a silence is, it costs three rows at most: the buckets that its ends share with other samples, and what lies between.
    ranges: cuts hot keys, see `running`.
    """
    if mode not in ("weighted", "latest"):
        raise ValueError(f"mode must be weighted or latest, not {mode}")
    if mode == "latest":
        samples = last_sample(samples, keys, time, interval_ms, tiebreak).drop("bucket")
    rows = running(samples.select(*keys, time, *tiebreak, value), keys, [time, *tiebreak], before={"__start": F.col(time)}, ranges=ranges)
    held = rows.select(*keys, F.col(time).alias("__end"), F.col(value).alias("__value"), "__start").filter("__start < __end")
    if max_gap is not None:
        held = held.filter(F.col("__end") - F.col("__start") <= max_gap)
    first, last = bucket(F.col("__start"), interval_ms), bucket(F.col("__end") - 1, interval_ms)
    whole_from = F.when(first == F.col("__start"), first).otherwise(first + interval_ms)
    whole_to = F.when(last + interval_ms == F.col("__end"), F.col("__end")).otherwise(last)

    def part(start: Column, end: Column, weight: Column, when: Column) -> Column:
        return F.when(when, F.struct(start.alias("from_ms"), end.alias("to_ms"), weight.alias("__weight")))

    head = part(first, first + interval_ms, F.least(F.col("__end"), first + interval_ms) - F.col("__start"), first < whole_from)
    inner = part(whole_from, whole_to, F.lit(None).cast("long"), whole_from < whole_to)
    tail = part(last, last + interval_ms, F.col("__end") - last, (whole_to == last) & ((first < last) | (first == whole_from)))
    parts = held.select(*keys, "__value", F.inline(F.filter(F.array(head, inner, tail), lambda p: p.isNotNull())))
    shared = parts.filter("__weight IS NOT NULL").groupBy(*keys, "from_ms", "to_ms").agg(F.try_divide(F.sum(F.col("__weight") * F.col("__value")), F.sum("__weight")).alias(value))
    return parts.filter("__weight IS NULL").select(*keys, "from_ms", "to_ms", F.col("__value").cast(shared.schema[value].dataType).alias(value)).unionByName(shared)


def align(samples: DataFrame, keys: Sequence[str], time: str, value: str, interval_ms: int = 5000, mode: str = "weighted", tiebreak: Sequence[str] = (), max_gap: int | None = None, ranges: int | None = None) -> DataFrame:
    """Per key and bucket the time-weighted average of samples, each of which holds since the key's sample before it.

    A key's first sample gives nothing, nor does one that is more than max_gap later than the one before; without max_gap, a silence
    gives a row for each of its buckets (see align_runs). mode 'latest' uses only the last sample of each bucket.
    """
    runs = align_runs(samples, keys, time, value, interval_ms, mode, tiebreak, max_gap, ranges)
    return runs.select(*keys, F.explode(_buckets(F.col("from_ms"), F.col("to_ms"), interval_ms)).alias("bucket"), value)


def attribute_resources(thread_samples: DataFrame, ops: DataFrame, value: str, interval_ms: int = 5000, dims: Sequence[str] = ("op", "index_name", "shard_id"), thread: Sequence[str] = ("node_id", "thread_id")) -> DataFrame:
    """Per bucket, node and dims of an operation: the share of its thread's value that its time there takes.

    thread_samples: thread keys, bucket, value. ops: thread keys, dims, start_ms, finish_ms.
    What no operation takes goes to an operation 'other' whose further dims are null.
    """
    parts = ops.filter("start_ms < finish_ms").withColumn("bucket", F.explode(_buckets(F.col("start_ms"), F.col("finish_ms"), interval_ms)))
    on = [*thread, "bucket"]
    busy = parts.groupBy(*on, *dims).agg(F.sum(_overlap(F.col("start_ms"), F.col("finish_ms"), interval_ms)).alias("__busy"))
    # a thread has as many operations in a bucket as start there or run on, and 'other' is one more row of theirs
    held = busy.groupBy(*on).agg(F.collect_list(F.struct(*dims, "__busy")).alias("__ops"), F.sum("__busy").alias("__all"))
    idle = (1 - F.least(F.coalesce("__all", F.lit(0)) / interval_ms, F.lit(1.0))).cast("double")
    nothing = [F.lit("other").alias(d) if d == dims[0] else F.lit(None).cast(ops.schema[d].dataType).alias(d) for d in dims]
    share = lambda o: F.struct(*[o[d].alias(d) for d in dims], (o["__busy"] / interval_ms).cast("double").alias("__share"))
    every = F.concat(F.coalesce(F.transform("__ops", share), F.array()), F.array(F.struct(*nothing, idle.alias("__share"))))
    rows = thread_samples.join(held, on, "left").select("bucket", thread[0], value, F.inline(every))
    return rows.groupBy("bucket", thread[0], *dims).agg(F.sum(F.col(value) * F.col("__share")).alias(value))


def gate_by_collector(samples: DataFrame, enabled: DataFrame, collector: str = "collector") -> DataFrame:
    """Samples of enabled collectors; without any, nothing."""
    return samples.join(enabled.select(collector).distinct(), collector, "left_semi")


def covered(events: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, ranges: int | None = None) -> DataFrame:
    """Events at whose time some interval [from_ms, to_ms) of their keys holds; to_ms null: without an end. Null keys and times are in none.

    Intervals and events go along a key's time line together. An interval begun by then covers an event if and only if the latest of their
    ends is later than the event: what is carried is that end. An interval is a row, however long it is. ranges: see `running`.
    """
    at, is_event, end, most = (unused([*events.columns, *intervals.columns], n) for n in ("__at", "__is_event", "__end", "__most"))
    begun = intervals.filter(F.col("from_ms").isNotNull()).select(*keys, F.col("from_ms").cast("long").alias(at), F.lit(0).alias(is_event), F.coalesce(F.col("to_ms").cast("long"), F.lit((1 << 63) - 1)).alias(end))
    for k in keys:
        begun = begun.filter(F.col(k).isNotNull())
    rows = events.withColumns({at: F.col(time).cast("long"), is_event: F.lit(1), end: F.lit(None).cast("long")}).unionByName(begun, allowMissingColumns=True)
    found = running(rows, keys, [at, is_event], most={most: F.col(end)}, ranges=ranges)
    return found.filter((F.col(is_event) == 1) & (F.col(most) > F.col(at))).select(*[F.col(f"`{c}`") for c in events.columns])


def gate_by_state(events: DataFrame, intervals: DataFrame, time: str, cluster: str = "cluster_id", feature: str = "pipeline", ranges: int | None = None) -> DataFrame:
    """Events at whose time the feature was on. intervals: cluster, feature, from_ms, to_ms (null: still), enabled, as fold_feature_state gives them."""
    return covered(events, intervals.filter((F.col("feature") == feature) & F.col("enabled")).select(cluster, "from_ms", "to_ms"), [cluster], time, ranges)


def gate_as_of(samples: DataFrame, intervals: DataFrame, time: str, cluster: str = "cluster_id", collector: str = "collector", kind: str = "collectors", ranges: int | None = None) -> DataFrame:
    """Samples whose collector was enabled in their cluster at their time. intervals: as override_intervals gives them."""
    on = intervals.filter(F.col("kind") == kind).select(F.col(cluster), F.col("name").alias(collector), "from_ms", "to_ms")
    return covered(samples, on, [cluster, collector], time, ranges)


def with_units(metrics: DataFrame, units: DataFrame) -> DataFrame:
    """The unit of each metric; null where none is known."""
    return metrics.join(units.select("metric", "unit"), "metric", "left")
