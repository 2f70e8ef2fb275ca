"""Start and finish events: pairing, and the metrics of operations.

Joins are equi joins on the keys of the operation; Spark chooses the strategy, and
adaptive execution splits skewed keys. Latencies are milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket, task_metadata, task_type
from .running import running

#: Keys of an operation, as the path of its events carries them.
KEYS = ("node_id", "thread_id", "op", "op_id")
EXPIRY_MS = 600_000


def _joined(starts: DataFrame, finishes: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Finish columns that starts have too, other than keys, get the suffix _finish."""
    clash = {c: f"{c}_finish" for c in finishes.columns if c in starts.columns and c not in keys}
    other = finishes.withColumnsRenamed(clash).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("finish_ms") >= F.col("start_ms")]
    found = starts.join(other, on, how)
    both = [F.coalesce(k, f"__{k}").alias(k) for k in keys]
    rest = [c for c in found.columns if c not in keys and not (c.startswith("__") and c[2:] in keys)]
    return found.select(*both, *rest).withColumn("latency_ms", F.col("finish_ms") - F.col("start_ms"))


def pair_events(starts: DataFrame, finishes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Operations with both events: keys, attributes of both sides, latency_ms. Null keys never pair."""
    return _joined(starts, finishes, keys, "inner")


def classify_pairs(starts: DataFrame, finishes: DataFrame, now_ms: int | Column, keys: Sequence[str] = KEYS, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """All operations with their state: complete, in_flight, expired (no finish after expiry_ms), orphan_finish."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    state = (
        F.when(F.col("start_ms").isNull(), "orphan_finish")
        .when(F.col("finish_ms").isNotNull(), "complete")
        .when(F.col("start_ms") >= now - expiry_ms, "in_flight")
        .otherwise("expired")
    )
    return _joined(starts, finishes, keys, "full_outer").withColumn("state", state)


def pair_counts(classified: DataFrame) -> DataFrame:
    """Number of operations in each state."""
    return classified.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def implicit_finish(ops: DataFrame, thread: Sequence[str] = ("node_id", "thread_id"), order: Sequence[str] = ("start_ms", "op_id"), ranges: int | None = None) -> DataFrame:
    """Operations that own their thread: one without a finish ends when the next one starts there. ranges: see `running`."""
    rows = running(ops, thread, order, after={"__after": F.col("start_ms")}, ranges=ranges)
    return rows.withColumn("finish_ms", F.coalesce("finish_ms", "__after")).withColumn("latency_ms", F.col("finish_ms") - F.col("start_ms")).drop("__after")


def _latency() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("items").alias("items"),
        F.sum("latency_ms").alias("latency_sum"),
        F.avg("latency_ms").alias("latency_avg"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
    ]


def http_metrics(starts: DataFrame, finishes: DataFrame, interval_ms: int = 5000, keys: Sequence[str] = ("node_id", "kind", "id")) -> DataFrame:
    """Count, items and latency of requests by bucket of their finish, kind, indices, status and exception."""
    pairs = pair_events(starts, finishes, keys).withColumn("bucket", bucket(F.col("finish_ms"), interval_ms))
    return pairs.groupBy("bucket", "kind", "indices", "status", "exception").agg(*_latency())


def shard_op_metrics(starts: DataFrame, finishes: DataFrame, interval_ms: int = 5000, dims: Sequence[str] = ("op", "index_name", "shard_id"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, items, latency and failures of shard operations by bucket of their finish and dims."""
    pairs = pair_events(starts, finishes, keys).withColumn("bucket", bucket(F.col("finish_ms"), interval_ms))
    failures = F.sum(F.col("failed").cast("int"))
    return pairs.groupBy("bucket", *dims).agg(*_latency(), failures.alias("failures"), F.try_divide(failures, F.count(F.lit(1))).alias("failure_rate"))


def fault_metrics(events: DataFrame, interval_ms: int = 5000) -> DataFrame:
    """Checks between nodes by bucket, type, source and target: count, mean latency, faults. An event without a start time is a finish."""
    text = F.col("start_ms").cast("string")
    is_start = F.coalesce(text, F.lit("")) != ""
    keys = ["type", "request_id"]
    starts = events.filter(is_start).select(*keys, "source_node", "target_node", F.col("start_ms").cast("long").alias("start_ms"))
    finishes = events.filter(~is_start).select(*keys, F.col("finish_ms").cast("long").alias("finish_ms"), "fault")
    pairs = pair_events(starts, finishes, keys).withColumn("bucket", bucket(F.col("finish_ms"), interval_ms))
    return pairs.groupBy("bucket", "type", "source_node", "target_node").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("latency_avg"), F.sum(F.col("fault").cast("int")).alias("faults")
    )


def poll_to_events(polls: DataFrame, interval_ms: int = 1000, node: Sequence[str] = ("node_id",), order: Sequence[str] = ("poll_ms", "seq"), ranges: int | None = None, cut: str | None = None) -> DataFrame:
    """Polls of a queue's head to start and finish events of its tasks, both stamped half an interval before the poll.

    `run` counts a node's starts, so that a task that comes to the head again is another run. ranges, cut: see `running`; the events keep cut.
    """
    head = F.coalesce("head_order", F.lit(-1).cast("long"))
    rows = running(polls.withColumn("__head", head), node, order, before={"__before": F.col("__head")}, ranges=ranges, cut=cut)
    rows = rows.withColumn("__before", F.coalesce("__before", F.lit(-1).cast("long"))).filter("__head <> __before")
    rows = running(rows, node, order, sums={"__run": (F.col("__head") != -1).cast("long")}, ranges=ranges, cut=cut)
    started = F.coalesce(F.col("__head") != -1, F.lit(False))
    extra = [c for c in ("priority", "age_ms", "thread_id") if c in polls.columns]
    null = lambda c: F.lit(None).cast(polls.schema[c].dataType)

    def event(kind: str, task: str, run: Column, own: bool) -> Column:
        source = F.col("source") if own else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("event"), F.col(task).alias("task"), run.alias("run"), task_type(source).alias("task_type"), task_metadata(source).alias("metadata"),
            *[(F.col(c) if own else null(c)).alias(c) for c in extra],
        )

    finish = F.when(F.col("__before") != -1, event("finish", "__before", F.col("__run") - started.cast("long"), False))
    start = F.when(started, event("start", "__head", F.col("__run"), True))
    both = F.filter(F.array(finish, start), lambda e: e.isNotNull())
    return rows.select(*[cut] * (cut is not None), *node, order[-1], (F.col("poll_ms") - interval_ms // 2).alias("time_ms"), F.inline(both))


def task_runs(events: DataFrame, node: Sequence[str] = ("node_id",), ranges: int | None = None, cut: str | None = None) -> DataFrame:
    """Runs of poll_to_events by task type: count, sums of run time and of time in the queue. ranges, cut: see `running`.

    A node has one task at the head of its queue, so a run's finish is the next event of its task after the start: no join is needed.
    """
    # of a run's events at one time the start comes first
    rows = events.withColumn("__ends", (F.col("event") != "start").cast("int"))
    rows = running(rows, node, ["time_ms", "run", "__ends"], after={"__next": F.struct("event", "task", "run", "time_ms")}, ranges=ranges, cut=cut)
    starts = rows.filter((F.col("event") == "start") & (F.col("__next.event") == "finish") & (F.col("__next.task") == F.col("task")) & (F.col("__next.run") == F.col("run")))
    queued = F.sum("age_ms") if "age_ms" in events.columns else F.lit(None).cast("long")
    return starts.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__next.time_ms") - F.col("time_ms")).alias("run_ms"), queued.alias("queue_ms"))
