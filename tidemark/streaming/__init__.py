"""Streaming twins of the batch operators."""

from __future__ import annotations

import contextlib
import json
import threading
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import bucket
from ..operators.events import EXPIRY_MS, KEYS
from ..sources.shared import File
from .ordered import Walk, walked
from .packed import Block, nulls


def route_buckets(events: DataFrame, purge_ms: int, interval_ms: int = 5000, time: str = "ms") -> DataFrame:
    """Adds `route` against a purge: current (the last whole bucket), next (the one that runs), stale (all else)."""
    now = purge_ms - purge_ms % interval_ms
    own = bucket(F.col(time), interval_ms)
    return events.withColumn("route", F.when(own == now - interval_ms, "current").when(own == now, "next").otherwise("stale"))


def fresh(events: DataFrame, time: str = "ts", grace: str = "5 seconds") -> DataFrame:
    """Events with a watermark: what is more than one bucket late is dropped, and counted as numRowsDroppedByWatermark."""
    return events.withWatermark(time, grace)


def stream_metrics(events: DataFrame, dims: Sequence[str], value: str, interval: str = "5 seconds", time: str = "ts", grace: str = "5 seconds") -> DataFrame:
    """Per bucket and dims: count, sum, min, max of value; for the append mode, which emits a bucket once it is final."""
    made = fresh(events, time, grace).groupBy(F.window(time, interval).alias("w"), *dims)
    made = made.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return made.select(F.unix_millis("w.start").alias("bucket"), *dims, "n", "sum", "min", "max")


def _stream_joined(starts: DataFrame, finishes: DataFrame, keys: Sequence[str], grace: str, expiry_ms: int, how: str) -> DataFrame:
    clash = {c: f"{c}_finish" for c in finishes.columns if c in starts.columns and c not in keys}
    # state is looked up by key, nulls included: a null key gets a side of its own, which the other stream doesn't have
    side = lambda own: F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), own).otherwise("both")
    other = finishes.withColumn("__finish_side", side("finish")).withWatermark("finish_ts", grace).withColumnsRenamed(clash).withColumnsRenamed({k: f"__{k}" for k in keys})
    starts = starts.withColumn("__start_side", side("start"))
    on = [*[F.col(k) == F.col(f"__{k}") for k in keys], F.col("__start_side") == F.col("__finish_side")]
    on += [F.col("finish_ts") >= F.col("start_ts"), F.col("finish_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {expiry_ms} MILLISECONDS")]
    found = starts.withWatermark("start_ts", grace).join(other, on, how).drop("__start_side", "__finish_side")
    both = [F.coalesce(k, f"__{k}").alias(k) for k in keys]
    rest = [c for c in found.columns if c not in keys and not (c.startswith("__") and c[2:] in keys)]
    return found.select(*both, *rest).withColumn("latency_ms", F.unix_millis("finish_ts") - F.unix_millis("start_ts"))


def stream_pair_events(starts: DataFrame, finishes: DataFrame, keys: Sequence[str] = KEYS, grace: str = "5 seconds", expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Starts with their finish within expiry_ms; those that stay open that long come without one. Times are start_ts and finish_ts."""
    return _stream_joined(starts, finishes, keys, grace, expiry_ms, "left_outer")


def stream_classify_pairs(starts: DataFrame, finishes: DataFrame, keys: Sequence[str] = KEYS, grace: str = "5 seconds", expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """All operations with their state once it is final: complete, expired (no finish within expiry_ms), orphan_finish (no start that it could belong to).

    A full outer join of two streams. A start is held until no finish within expiry_ms can come any more, a finish until no start
    before it can; until then an operation is in flight and gives no row. A finish later than expiry_ms is
    an orphan, and its start has expired. Null keys never pair. The stream must read on for expiry_ms and grace
    beyond an operation to give its state.
    """
    state = F.when(F.col("start_ts").isNull(), "orphan_finish").when(F.col("finish_ts").isNull(), "expired").otherwise("complete")
    return _stream_joined(starts, finishes, keys, grace, expiry_ms, "full_outer").withColumn("state", state)


#: What a counter's growth counts as, by kind: from (value, time, value before, time before, longest gap).
def _delta(kind: str, value: int, time: int, before: int | None, when: int | None, gap: int | None) -> int:
    if before is None:
        return value if kind == "first_absolute" else 0 if kind == "max_gap" else max(value, 0) if kind == "baseline_zero" else value
    if kind == "max_gap" and time - when > gap:
        return 0
    return value - before if kind == "baseline_zero_signed" else max(value - before, 0)


DELTAS = ("first_absolute", "max_gap", "baseline_zero", "baseline_zero_signed")


def _first_null(a: int | None, b: int | None) -> tuple:
    """Sort key with nulls first, as windows have it."""
    return a is not None, a or 0, b is not None, b or 0


def stream_counter_deltas(
    samples: DataFrame, keys: Sequence[str], time: str, tiebreak: str, counter: str, kind: str = "first_absolute", max_gap: int | None = None,
    ts: str | None = None, grace: str = "5 seconds", ordered: bool = False, slot_ms: int = 60_000, ttl_ms: int | None = None,
) -> DataFrame:
    """Keys, time, tiebreak and `delta` of each sample; a key's last sample is its state. Kinds: those of the batch operators.

    A null counter gives a null delta and is no baseline. A key's samples must not come late by more than a
    micro-batch; within one they are put in order. ts names `time` as a timestamp: samples later than its watermark
    allows are dropped then, and for max_gap the state of a key ends once it was silent for that long, as its next
    sample gives 0 either way. Other kinds keep their baseline for ever, as it must outlive any silence, unless ttl_ms
    gives the time after which a silent key's state may go (without ts). ordered (with ts): samples wait for the watermark, and so are in
    order across micro-batches too. slot_ms: how much of a key's time is put in order at once.
    """
    if kind not in DELTAS or (kind == "max_gap") != (max_gap is not None):
        raise ValueError(f"kind must be one of {', '.join(DELTAS)}; max_gap goes with the second")
    if (ordered and ts is None) or (ttl_ms is not None and ts is not None):
        raise ValueError("ordered needs ts, and ttl_ms goes without")
    emitted = T.StructType([T.StructField(time, T.LongType()), T.StructField(tiebreak, T.LongType()), T.StructField("delta", T.LongType())])

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        t, tie, v = row
        before, when = state or (None, None)
        made = [(t, tie, None if v is None else _delta(kind, v, t, before, when, max_gap))]
        return (state if v is None else (v, t)), made

    held = samples if ts is None else samples.withWatermark(ts, grace)
    walk = Walk(
        T.StructType([T.StructField(c, T.LongType()) for c in ("time", "tie", "value")]), T.StructType.fromDDL("value long, time long"), emitted, step,
        lambda r: _first_null(r[0], r[1]), lambda r: r[0], slot_ms, max_gap if ts is not None else None, ordered, ttl_ms, by=("time", "tie"),
    )
    named = held.select(*keys, F.col(time).cast("long").alias("time"), F.col(tiebreak).cast("long").alias("tie"), F.col(counter).cast("long").alias("value"), *[ts] * (ts is not None))
    return walked(named, keys, walk)


def stream_poll_events(polls: DataFrame, interval_ms: int = 1000, slot_ms: int = 60_000) -> DataFrame:
    """node_id, seq, time_ms, event, task, run, task_type, metadata of polls (node_id, seq, poll_ms, head_order, source). State: a node's head and number of starts."""
    emitted = T.StructType.fromDDL("seq long, time_ms long, event string, task long, run long, task_type string, metadata string")

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        ms, seq, task, source = row
        head, n = state or (-1, 0)
        task = -1 if task is None else task
        made = []
        if task != head:
            at = None if ms is None else ms - interval_ms // 2
            if head != -1:
                made.append((seq, at, "finish", head, n, None, None))
            if task != -1:
                n += 1
                kind, space, rest = (None, "", "") if source is None else source.partition(" ")
                made.append((seq, at, "start", task, n, kind, None if kind is None else space + rest))
        return (task, n), made

    fields, state = T.StructType.fromDDL("poll_ms long, seq long, head_order long, source string"), T.StructType.fromDDL("head long, run long")
    return walked(polls.select("node_id", *[F.col(f.name).cast(f.dataType) for f in fields]), ["node_id"], Walk(fields, state, emitted, step, lambda r: _first_null(r[0], r[1]), lambda r: r[0], slot_ms, by=("poll_ms", "seq")))


def stream_implicit_finish(starts: DataFrame, slot_ms: int = 60_000) -> DataFrame:
    """node_id, thread_id, op_id, start_ms, finish_ms of operations (node_id, thread_id, op_id, start_ms) that end when the next starts on their thread. State: a thread's open operation.

    An operation without a start time comes first on its thread, as in the batch operator.
    """
    emitted = T.StructType.fromDDL("op_id long, start_ms long, finish_ms long")

    def along(state: tuple | None, block: Block) -> tuple[tuple, list[tuple]]:
        columns = [(block[name], nulls(block, i)) for i, name in enumerate(("op_id", "start_ms"))]
        first = state or (None, None)
        before = [(np.append(v or 0, values[:-1]), np.append(v is None, null[:-1])) for v, (values, null) in zip(first, columns, strict=True)]
        skipped = int(state is None)
        made = [(values[skipped:], null[skipped:]) for values, null in [*before, columns[1]]]
        return tuple(None if null[-1] else int(values[-1]) for values, null in columns), made

    fields = T.StructType.fromDDL("op_id long, start_ms long")
    walk = Walk(fields, fields, emitted, None, lambda r: _first_null(r[1], r[0]), lambda r: r[1], slot_ms, by=("start_ms", "op_id"), along=along)
    return walked(starts.select("node_id", "thread_id", *[F.col(f.name).cast(f.dataType) for f in fields]), ["node_id", "thread_id"], walk)


def dropped_late(query: StreamingQuery) -> int:
    """Late events that a stream has dropped so far, in the progress that it still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


class LateCounter(StreamingQueryListener):
    """Adds up the late events that streams drop, over their whole lives.

    They are counted where they are dropped: an aggregation combines a task's events of one bucket and key before, and
    drops and counts them as one; joins and stateful processors drop and count each.

    A stream's count is a small file, named after its id, which its checkpoint keeps across restarts. A micro-batch counts once: the file
    holds the last one that it has. Use as a context: within it, the counts of all of the session's streams are kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.seen: dict[str, int] = {}
        self.changed = threading.Condition()

    def __enter__(self) -> LateCounter:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def _file(self, query_id: str) -> File:
        return File(self.spark, f"{self.path}/late-{query_id}.json")

    def count(self, query_id: str) -> int:
        """Late events of a stream so far; 0 for one that was never seen."""
        return json.loads(self._file(str(query_id)).read() or '{"late": 0}')["late"]

    def wait_for(self, query: StreamingQuery, seconds: float = 30) -> int:
        """The count of a stream that has ended, once its last progress has come: progress comes after its micro-batch."""
        last = query.lastProgress
        with self.changed:
            if last is not None and not self.changed.wait_for(lambda: self.seen.get(str(query.id), -1) >= last["batchId"], seconds):
                raise TimeoutError("the progress of the last micro-batch hasn't come")
        return self.count(query.id)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        file = self._file(str(p.id))
        held = json.loads(file.read() or '{"batch": -1, "late": 0}')
        if p.batchId > held["batch"]:
            file.replace(json.dumps({"batch": p.batchId, "late": held["late"] + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)}))
        with self.changed:
            self.seen[str(p.id)] = max(p.batchId, self.seen.get(str(p.id), -1))
            self.changed.notify_all()


def run_available(stream: DataFrame, path: str, checkpoint: str, counts: dict[str, int] | None = None) -> DataFrame:
    """Runs a stream over all that there is into Parquet at path, and reads it. Each batch is committed once.

    counts gets `late`, the late events that the stream has dropped since its checkpoint began; they are kept beside the checkpoint.
    """
    counter = None if counts is None else LateCounter(stream.sparkSession, f"{checkpoint}-counts")
    with counter or contextlib.nullcontext():
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if counter:
            counts["late"] = counter.wait_for(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
