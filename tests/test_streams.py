import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import streaming
from tidemark.operators import counters, events
from tidemark.streaming import ordered, packed


def files(spark, tmp_path, parts):
    """A stream that reads one of parts in each micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")


def ran(stream, tmp_path):
    return streaming.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/progress")


def test_routes_against_a_purge(spark):
    df = spark.createDataFrame([(4999,), (5000,), (9999,), (10000,), (14999,), (15000,)], "ms long")
    found = {r["ms"]: r["route"] for r in streaming.route_buckets(df, 12_500).collect()}
    assert found == {4999: "stale", 5000: "current", 9999: "current", 10000: "next", 14999: "next", 15000: "stale"}


@pytest.mark.parametrize("kind", ["first_absolute", "max_gap", "baseline_zero_signed"])
def test_deltas_over_batches(spark, tmp_path, kind):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 1000).alias("t"), F.col("id").alias("seq"), (F.col("id") * 7 % 31).alias("v"))
    stream = files(spark, tmp_path, [df.filter("id < 25"), df.filter("id >= 25")])
    gap = 2500 if kind == "max_gap" else None
    got = ran(streaming.stream_counter_deltas(stream, ["k"], "t", "seq", "v", kind, gap), tmp_path)
    if kind == "first_absolute":
        want = counters.delta_first_absolute(df, ["k"], ["seq"], ["v"]).withColumnRenamed("v", "delta")
    elif kind == "max_gap":
        want = counters.delta_max_gap(df, ["k"], "t", "v", 2500, ["seq"])
    else:
        want = counters.interval_failures(df, ["k"], ["seq"], "v", clamp=False).withColumnRenamed("failures", "delta")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "seq", "delta").collect())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("kind", ["first_absolute", "max_gap", "baseline_zero", "baseline_zero_signed"])
def test_null_counters_and_large_numbers(spark, tmp_path, kind):
    large = (1 << 53) + 1
    data = [("k", 1, 1, large), ("k", 2, 2, None), ("k", 3, 3, large + 4), ("k", 9, 4, large + 5), ("k", 10, 5, 7), (None, 1, 6, None), (None, 2, 7, 3)]
    df = spark.createDataFrame(data, "k string, t long, seq long, v long")
    stream = files(spark, tmp_path, [df.filter("seq in (1, 2, 6)"), df.filter("seq not in (1, 2, 6)")])
    got = ran(streaming.stream_counter_deltas(stream, ["k"], "t", "seq", "v", kind, 3 if kind == "max_gap" else None), tmp_path)
    if kind == "first_absolute":
        want = counters.delta_first_absolute(df, ["k"], ["t", "seq"], ["v"]).withColumnRenamed("v", "delta")
    elif kind == "max_gap":
        want = counters.delta_max_gap(df, ["k"], "t", "v", 3, ["seq"])
    else:
        want = counters.interval_failures(df, ["k"], ["t"], "v", clamp=kind == "baseline_zero").withColumnRenamed("failures", "delta")
    rows = lambda d: sorted((tuple(r) for r in d.select("seq", "delta").collect()), key=str)
    assert rows(got) == rows(want)
    first = {"first_absolute": large, "max_gap": 0, "baseline_zero": large, "baseline_zero_signed": large}[kind]
    assert rows(got)[:4] == [(1, first), (2, None), (3, 4), (4, 0 if kind == "max_gap" else 1)]


def test_silent_keys_lose_their_state(spark, tmp_path):
    data = [("a", 1000, 1, 5), ("a", 2000, 2, 9), ("b", 90_000, 3, 1), ("b", 200_000, 4, 2), ("b", 201_000, 5, 3), ("a", 202_000, 6, 30)]
    df = spark.createDataFrame(data, "k string, t long, seq long, v long").withColumn("ts", F.timestamp_millis("t"))
    stream = files(spark, tmp_path, [df.filter("seq <= 2"), df.filter("seq = 3"), df.filter("seq = 4"), df.filter("seq >= 5")])
    got = ran(streaming.stream_counter_deltas(stream, ["k"], "t", "seq", "v", "max_gap", 15_000, ts="ts"), tmp_path)
    assert sorted((r["seq"], r["delta"]) for r in got.collect()) == [(1, 0), (2, 4), (3, 0), (4, 0), (5, 1), (6, 0)]


def test_polls_and_starts_with_nulls_and_large_ids(spark, tmp_path):
    large = (1 << 53) + 1
    polls = [("n", 1, 1000, large, "a [x]"), ("n", 2, 2000, None, None), ("n", 3, 3000, large + 2, None), (None, 4, 1000, None, "b")]
    df = spark.createDataFrame(polls, "node_id string, seq long, poll_ms long, head_order long, source string")
    (tmp_path / "p").mkdir(), (tmp_path / "s").mkdir()
    got = ran(streaming.stream_poll_events(files(spark, tmp_path / "p", [df.filter("seq <> 3"), df.filter("seq = 3")])), tmp_path / "p")
    want = events.poll_to_events(df)
    rows = lambda d, *c: sorted((tuple(r) for r in d.select(*c).collect()), key=str)
    columns = ("node_id", "seq", "time_ms", "event", "task", "run", "task_type", "metadata")
    assert rows(got, *columns) == rows(want, *columns)
    assert {r["task"] for r in got.collect()} == {large, large + 2}
    starts = [("n", 1, large, 10), ("n", 1, None, 20), ("n", 1, large + 2, None), ("n", 1, large + 4, 30), (None, None, 5, 7), (None, None, 6, 8)]
    df = spark.createDataFrame(starts, "node_id string, thread_id long, op_id long, start_ms long")
    got = ran(streaming.stream_implicit_finish(files(spark, tmp_path / "s", [df])), tmp_path / "s")
    want = events.implicit_finish(df.withColumn("finish_ms", F.lit(None).cast("long"))).filter("finish_ms IS NOT NULL")
    columns = ("node_id", "thread_id", "op_id", "start_ms", "finish_ms")
    assert rows(got, *columns) == rows(want, *columns)


def test_open_starts_come_out_once_they_expire(spark, tmp_path):
    ts = lambda c: F.timestamp_millis(F.col(c) * 1000)
    keys = "op_id long, s long, f long"
    data = [(1, 10, 15), (2, 11, None), (3, 2000, 2001)]
    df = spark.createDataFrame(data, keys)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    starts = files(spark, tmp_path / "a", [df.select("op_id", ts("s").alias("start_ts"))])
    finishes = files(spark, tmp_path / "b", [df.filter("f IS NOT NULL").select("op_id", ts("f").alias("finish_ts"))])
    got = ran(streaming.stream_pair_events(starts, finishes, ["op_id"]), tmp_path)
    assert sorted((r["op_id"], r["latency_ms"]) for r in got.collect()) == [(1, 5000), (2, None), (3, 1000)]


def test_late_events_are_dropped_and_buckets_come_once(spark, tmp_path):
    # a batch drops what was late already before the one before it
    df = spark.createDataFrame([(0, 1), (4, 1), (30, 1), (31, 1), (1, 1), (60, 1)], "s long, v long").withColumn("ts", F.timestamp_millis(F.col("s") * 1000))
    parts = [df.filter("s in (0, 4)"), df.filter("s = 30"), df.filter("s = 31"), df.filter("s in (1, 60)")]
    counts = {}
    got = streaming.run_available(streaming.stream_metrics(files(spark, tmp_path, parts), [], "v"), f"file://{tmp_path}/out", f"file://{tmp_path}/progress", counts)
    assert counts == {"late": 1}
    assert sorted((r["bucket"], r["n"]) for r in got.collect()) == [(0, 2), (30_000, 2)]
    # the stream goes on after a restart, and so does the count
    df.filter("s in (0, 4)").withColumn("v", F.lit(5).cast("long")).coalesce(1).write.parquet(f"file://{tmp_path}/in/9")
    again = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    streaming.run_available(streaming.stream_metrics(again, [], "v"), f"file://{tmp_path}/out", f"file://{tmp_path}/progress", counts)
    assert counts == {"late": 2}  # both were of one bucket, and had been combined before they were dropped


def ordered_deltas(spark, tmp_path, df, parts, **how):
    return ran(streaming.stream_counter_deltas(files(spark, tmp_path, parts), ["k"], "t", "seq", "v", **how), tmp_path)


@pytest.mark.parametrize("kind", ["first_absolute", "max_gap"])
def test_samples_in_order_across_batches(spark, tmp_path, kind):
    """Samples that come late by two micro-batches, within what the watermark allows, count at their own time."""
    large = (1 << 53) + 1
    data = [("a", 1000, 1, large), ("a", 4000, 2, large + 9), ("a", 2000, 3, large + 2), ("b", 3000, 4, None), ("a", 3000, 5, None), ("b", 2500, 6, 7), ("c", 90_000, 7, 1)]
    df = spark.createDataFrame(data, "k string, t long, seq long, v long").withColumn("ts", F.timestamp_millis("t"))
    parts = [df.filter("seq <= 2"), df.filter("seq in (3, 4)"), df.filter("seq in (5, 6)"), df.filter("seq = 7")]
    gap = 1500 if kind == "max_gap" else None
    got = ordered_deltas(spark, tmp_path, df, parts, kind=kind, max_gap=gap, ts="ts", grace="10 seconds", ordered=True, slot_ms=1500)
    if kind == "max_gap":
        want = counters.delta_max_gap(df, ["k"], "t", "v", gap, ["seq"])
    else:
        want = counters.delta_first_absolute(df, ["k"], ["t", "seq"], ["v"]).withColumnRenamed("v", "delta")
    rows = lambda d: sorted(tuple(r) for r in d.select("k", "seq", F.coalesce("delta", F.lit(-1)).alias("d")).collect())
    assert rows(got) == rows(want.filter("k <> 'c'"))  # the last time isn't over yet


def test_a_hot_key_goes_through_the_state_store(spark, tmp_path):
    """One key with more rows in a micro-batch than are put in order at once, and rows without a time."""
    n = 30_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 7919 % n).alias("t"), F.col("id").alias("seq"), (F.col("id") * 31 % 1009).alias("v"))
    df = df.unionByName(spark.createDataFrame([("k", None, n, 5), ("k", None, n + 1, 6)], "k string, t long, seq long, v long"))
    got = ordered_deltas(spark, tmp_path, df, [df.repartition(1)], slot_ms=1000)
    want = counters.delta_first_absolute(df, ["k"], ["t", "seq"], ["v"]).withColumnRenamed("v", "delta")
    assert got.select("seq", "delta").exceptAll(want.select("seq", "delta")).count() == 0 and got.count() == n + 2


def test_state_that_has_expired_is_no_baseline(spark, tmp_path):
    df = spark.createDataFrame([("a", 1000, 1, 5), ("b", 500_000, 2, 1), ("b", 600_000, 3, 2), ("a", 601_000, 4, 6)], "k string, t long, seq long, v long").withColumn("ts", F.timestamp_millis("t"))
    parts = [df.filter(f"seq = {i}") for i in (1, 2, 3, 4)]
    progress = f"file://{tmp_path}/progress"
    got = ordered_deltas(spark, tmp_path, df, parts, kind="max_gap", max_gap=10_000, ts="ts")
    assert sorted((r["seq"], r["delta"]) for r in got.collect()) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    held = spark.read.format("statestore").option("path", progress).option("stateVarName", "carried").load()
    assert {r["key"]["k"]: r["value"]["time"] for r in held.select("key", "value").collect()} == {"a": 601_000, "b": 600_000}


def test_options_that_exclude_each_other(spark):
    df = spark.createDataFrame([], "k string, t long, seq long, v long, ts timestamp")
    for how in ({"ordered": True}, {"ts": "ts", "ttl_ms": 5}, {"kind": "x"}, {"kind": "max_gap"}):
        with pytest.raises(ValueError):
            streaming.stream_counter_deltas(df, ["k"], "t", "seq", "v", **how)


def test_states_of_pairs_as_in_batch(spark, tmp_path):
    """Three micro-batches with late finishes, null keys, ids above 2^53 and repeated finishes."""
    large = (1 << 53) + 1
    data = [  # batch, op_id, start, finish (seconds)
        (0, 1, 10, None), (0, large, 20, None), (0, large + 1, 30, None), (0, None, 31, None), (0, 5, 40, None), (0, 9, None, 5),
        (1, 1, None, 15), (1, large, None, 25), (1, large, None, 26), (1, None, None, 35), (1, 7, None, 36), (1, 5, None, 700), (1, 6, 650, 651),
        (2, 8, 2000, 2001), (2, 10, 5000, None),
    ]
    df = spark.createDataFrame(data, "batch int, op_id long, s long, f long")
    ts = lambda c: F.timestamp_millis(F.col(c) * 1000)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    starts, finishes = df.filter("s IS NOT NULL").select("batch", "op_id", ts("s").alias("start_ts")), df.filter("f IS NOT NULL").select("batch", "op_id", ts("f").alias("finish_ts"))
    read = lambda d, n: files(spark, tmp_path / n, [d.filter(f"batch = {i}").drop("batch") for i in range(3)])
    got = ran(streaming.stream_classify_pairs(read(starts, "a"), read(finishes, "b"), ["op_id"], "100 seconds", 600_000), tmp_path)
    rows = lambda d: sorted((str(r["op_id"]), r["state"], r["latency_ms"]) for r in d.collect())
    milli = lambda d, c: d.select("op_id", F.unix_millis(f"{c}_ts").alias(f"{c}_ms"))
    want = events.classify_pairs(milli(starts, "start"), milli(finishes, "finish"), 2001_000, ["op_id"], 600_000)
    # a pair that took longer than operations may stay open is two rows of the stream, and what is still open gives none
    late = [("5", "expired", None), ("5", "orphan_finish", None)]
    assert rows(got) == sorted([r for r in rows(want) if r[0] not in ("5", "10")] + late, key=str)


class Held:
    """A value state outside of Spark, and a handle that gives no other state."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return None


def test_a_hot_key_is_emitted_in_frames_and_not_put_into_slots(spark):
    """Steps go no further than the frame that is taken, and rows of a micro-batch make no calls of the state store."""
    n, large = 50_000, (1 << 53) + 1
    steps = []
    fields, emitted = T.StructType.fromDDL("t long, v string"), T.StructType.fromDDL("t long, v string, before long")

    def step(state, row):
        steps.append(row)
        return (row[0],), [(*row, None if state is None else state[0])]

    walk = ordered.Walk(fields, T.StructType.fromDDL("t long"), emitted, step, lambda r: (r[0] is not None, r[0] or 0), lambda r: r[0], chunk=7_000)
    processor = ordered.OrderedProcessor(walk, ["k"])
    processor.init(Held())
    times = [large + i for i in range(n)]
    random.Random(1).shuffle(times)
    given = [pd.DataFrame({"k": "a", "t": times[i : i + 9_000], "v": "", ordered.BITS: 2}) for i in range(0, n, 9_000)]
    given.append(pd.DataFrame({"k": ["a"], "t": [0], "v": ["x"], ordered.BITS: [1]}))
    frames = processor.handleInputRows(("a",), iter(given), None)
    first = next(frames)
    assert len(first) == len(steps) == ordered.EMITTED
    assert [tuple(r) for r in first.head(3).itertuples(index=False)] == [("a", None, "x", None), ("a", large, None, None), ("a", large + 1, None, large)]
    rest = pd.concat(frames)
    assert rest["t"].tolist() == sorted(times)[ordered.EMITTED - 1 :] and processor.carried.get() == (large + n - 1,)


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 30, 499])
def test_sorted_files_are_merged(n):
    rows = [(i * 7919 % 101, i) for i in range(n)]
    assert list(ordered.in_order(iter(rows), lambda r: r, chunk=10, files=3)) == sorted(rows)


def test_keys_of_any_type_keep_their_values(spark, tmp_path):
    some = "(1L << 53) + 1 + id % 2 AS a, 0.1D * (id % 2) AS b, timestamp_micros(1704067200000001 + id % 2) AS c, id % 2 = 0 AS d, concat(char(1), char(34)) AS e, 12345678901234567890.12BD + id % 2 AS f"
    df = spark.sql(f"SELECT if(id < 6, a, null) AS a, if(id < 6, b, null) AS b, if(id < 6, c, null) AS c, if(id < 6, d, null) AS d, if(id < 6, e, null) AS e, if(id < 6, f, null) AS f, id, id AS seq, id AS v FROM (SELECT {some}, id FROM range(8))")
    keys = ["a", "b", "c", "d", "e", "f"]
    got = ran(streaming.stream_counter_deltas(files(spark, tmp_path, [df]), keys, "id", "seq", "v"), tmp_path)
    want = counters.delta_first_absolute(df, keys, ["id"], ["v"]).withColumnRenamed("v", "delta")
    rows = lambda d: sorted((tuple(r) for r in d.select(*keys, "id", "delta").collect()), key=lambda r: r[-2])
    assert rows(got) == rows(want)


def unordered(n, seed=3, size=700):
    """Blocks of rows that repeat times, some without a time, and the rows in order."""
    random.Random(seed).shuffle(rows := [(None if i % 97 == 0 else i * 7919 % 1009, i) for i in range(n)])
    columns = {"t": np.array([t or 0 for t, _ in rows], np.int64), "i": np.array([i for _, i in rows], np.int64), packed.BITS: np.array([int(t is None) for t, _ in rows], np.int64)}
    return [{c: v[at : at + size] for c, v in columns.items()} for at in range(0, n, size)], sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("n", "size"), [(0, 700), (1, 700), (1000, 700), (1001, 7), (9000, 700), (30_000, 700), (5000, 5000)])
def test_blocks_are_merged_from_files(n, size):
    blocks, want = unordered(n, size=size)
    found = list(packed.blocks_in_order(blocks, [("t", 0), ("i", 1)], chunk=1000, files=3, size=50))
    got = [(None if bits else t, i) for b in found for t, i, bits in zip(b["t"].tolist(), b["i"].tolist(), b[packed.BITS].tolist(), strict=True)]
    assert got == want and all(0 < len(b["t"]) <= 50 for b in found)


@pytest.mark.parametrize("overlap", [True, False])
def test_a_merge_holds_a_block_and_a_half_of_each_file(overlap):
    """Files read side by side, or one after another, are never read far ahead of what is emitted."""
    n, size, read = 4, 50, 0

    def source(k):
        nonlocal read
        for at in range(0, 2000, size):
            times = np.arange(at, at + size, dtype=np.int64)
            read += size
            yield {"t": times * n + k if overlap else times + 2000 * k, packed.BITS: np.zeros(size, np.int64)}

    emitted, got = 0, []
    for block in packed.merged([source(k) for k in range(n)], [("t", 0)], size):
        emitted += len(block["t"])
        got += block["t"].tolist()
        assert read - emitted <= n * size * 2
    assert got == list(range(2000 * n))


def test_rows_are_packed_by_key():
    keys = [None, "a", "", "b", "a", None] * 50
    batch = pa.RecordBatch.from_pydict({"k": keys, "m": ["x", "y"] * 150, "v": list(range(300)), "s": [str(i) for i in range(300)]})
    made = packed.pack(batch, 2, 32)
    found = [(r["k"], r["m"], v, s) for r in made.to_pylist() for v, s in zip(r["v"], r["s"], strict=True)]
    assert sorted(found, key=lambda r: r[2]) == [tuple(r.values()) for r in batch.to_pylist()]
    assert sorted(len(r["v"]) for r in made.to_pylist()) == sorted([32, 18] * 6)


def test_ends_along_packed_rows_and_over_batches(spark, tmp_path):
    """A stream's rows go to the processor packed, and give what the batch operator gives: hot keys, equal times, nulls, ids above 2^53."""
    large = (1 << 53) + 1
    df = spark.range(40_000).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id") % 2)).alias("node_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("thread_id"),
        (F.col("id") + large).alias("op_id"), F.when(F.col("id") != 11, F.floor(F.col("id") * 7919 % 20_000 / 2 + F.floor(F.col("id") / 20_000) * 100_000)).alias("start_ms"),
    )
    parts = [df.filter(f"op_id < {large + 20_000}"), df.filter(f"op_id >= {large + 20_000}")]
    stream = streaming.stream_implicit_finish(files(spark, tmp_path, parts))
    assert "MapInArrow" in stream._jdf.queryExecution().analyzed().toString()
    got = ran(stream, tmp_path)
    want = events.implicit_finish(df.withColumn("finish_ms", F.lit(None).cast("long"))).filter("finish_ms IS NOT NULL")
    columns = ("node_id", "thread_id", "op_id", "start_ms", "finish_ms")
    rows = lambda d: sorted((tuple(r) for r in d.select(*columns).collect()), key=str)
    assert rows(got) == rows(want)
