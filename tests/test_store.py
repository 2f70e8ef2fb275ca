"""The metric store: types, writes, streams into it, retention on disk, responses."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_streams import files
from tidemark import streaming
from tidemark.sources import shared, store

COLUMNS = "bucket long, node_id string, metric string, value double"
DAY = store.DAY_MS


def metrics(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def seen(spark, path, *between):
    return sorted((r["bucket"], r["metric"] or "", r["value"]) for r in store.read_metrics(spark, path, *between).collect())


def test_names_stay_as_they_were_written(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_metrics(metrics(spark, [(5000, "n", m, 1.0) for m in ("007", "7", "2024-01-01", "a/b=c", "", None)]), path)
    got = store.read_metrics(spark, path)
    # a folder can't tell an empty name from none
    assert sorted(r["metric"] or "" for r in got.collect()) == ["", "", "007", "2024-01-01", "7", "a/b=c"]
    assert dict(got.dtypes) == {"bucket": "bigint", "node_id": "string", "value": "double", "metric": "string"}


def test_all_null_metrics_and_empty_stores(spark, tmp_path):
    none, empty = (f"file://{tmp_path}/{n}" for n in ("none", "empty"))
    store.write_metrics(metrics(spark, [(0, "n", None, 1.0)]), none)
    assert dict(store.read_metrics(spark, none).dtypes)["metric"] == "string"
    store.write_metrics(metrics(spark, []), empty)
    got = store.read_metrics(spark, empty, 0, 10)
    assert got.collect() == [] and dict(got.dtypes)["value"] == "double"
    with pytest.raises(ValueError):
        store.read_metrics(spark, f"file://{tmp_path}/nowhere")


def test_columns_may_come_later_but_not_change(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_metrics(metrics(spark, [(0, "n", "cpu", 1.0)]), path)
    store.write_metrics(metrics(spark, [(1, "n", "cpu", 2.0)]).withColumn("shard_id", F.lit(3)), path)
    assert sorted((r["bucket"], r["shard_id"]) for r in store.read_metrics(spark, path).collect()) == [(0, None), (1, 3)]
    with pytest.raises(ValueError, match="value"):
        store.write_metrics(metrics(spark, [(2, "n", "cpu", 1.0)]).withColumn("value", F.lit("x")), path)


def test_buckets_that_run_are_held_back_and_days_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rest = store.write_metrics(metrics(spark, [(0, "n", "cpu", 1.0), (5000, "n", "cpu", 2.0), (DAY, "n", "cpu", 9.0)]), path, now=10_000)
    assert [r["bucket"] for r in rest.collect()] == [DAY]
    assert seen(spark, path) == [(0, "cpu", 1.0), (5000, "cpu", 2.0)]
    store.write_metrics(metrics(spark, [(DAY, "n", "cpu", 9.0), (0, "n", "ram", 4.0)]), path)
    store.write_metrics(metrics(spark, [(7000, "n", "cpu", 5.0)]), path, replace=True)
    assert seen(spark, path) == [(0, "ram", 4.0), (7000, "cpu", 5.0), (DAY, "cpu", 9.0)]
    assert seen(spark, path, 1, DAY) == [(7000, "cpu", 5.0)]


def final(stream):
    """Final buckets of a stream as metric rows."""
    made = streaming.stream_metrics(stream, ["node_id"], "v")
    return made.select("bucket", "node_id", F.lit("v").alias("metric"), F.col("sum").cast("double").alias("value"))


@pytest.mark.parametrize("dies", ["before the ledger", "after the ledger"])
def test_a_stream_that_died_writes_nothing_twice(spark, tmp_path, monkeypatch, dies):
    df = spark.range(400).select(F.timestamp_millis(F.col("id") * 500).alias("ts"), (F.col("id") % 2).cast("string").alias("node_id"), F.col("id").alias("v"))
    parts = [df.filter(F.floor(F.col("v") / 100) == i) for i in range(4)]
    stream = files(spark, tmp_path, parts)
    path, progress = f"file://{tmp_path}/store", f"file://{tmp_path}/progress"
    real, calls = shared.File.replace, []

    def dying(self, text):
        if "stream-agg" in self.path:
            calls.append(text)
            if len(calls) == 3:
                if dies == "after the ledger":
                    real(self, text)
                raise RuntimeError("lost")
        real(self, text)

    monkeypatch.setattr(shared.File, "replace", dying)
    query = store.stream_into_store(final(stream), path, progress, "agg")
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    monkeypatch.setattr(shared.File, "replace", real)
    whole = df.groupBy(F.window("ts", "5 seconds").start.alias("b"), "node_id").agg(F.sum("v").cast("double").alias("s"))
    want = sorted((r["b"], r["node_id"], r["s"]) for r in whole.select(F.unix_millis("b").alias("b"), "node_id", "s").collect())
    half = sorted((r["bucket"], r["node_id"], r["value"]) for r in store.read_metrics(spark, path).collect())
    assert half and set(half) < set(want)  # only buckets that are whole
    store.stream_into_store(final(stream), path, progress, "agg").awaitTermination()
    got = sorted((r["bucket"], r["node_id"], r["value"]) for r in store.read_metrics(spark, path).collect())
    assert got == [w for w in want if w[0] + 5000 <= 399 * 500 - 5000]
    assert store.write_batch(metrics(spark, [(0, "n", "x", 1.0)]), path, "agg", 1) is False
    # a batch that the ledger doesn't name is not seen
    store._write(metrics(spark, [(0, "n", "x", 1.0)]), path, "s-agg-000000000099", "append")
    store._write(metrics(spark, [(0, "n", "x", 1.0)]), path, "s-other-000000000000", "append")
    assert len(seen(spark, path)) == len(got)


def test_retention_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    minute = 60_000
    rows = [(t, "n", m, float(t)) for t in range(2 * DAY - 30 * minute, 2 * DAY + 40 * minute, minute) for m in ("a", "b")]
    store.write_metrics(metrics(spark, [(5000, "n", "a", 0.0)]), path)
    store.write_metrics(metrics(spark, rows), path)
    now = 2 * DAY + 40 * minute
    reader = store.read_metrics(spark, path)
    every = len(reader.collect())
    assert store.retain_store(spark, path, now, 60) == {"days": 0, "rewritten": 2 * 20, "writes": 0}
    since = lambda cut: sorted((t, m, v) for t, _, m, v in rows if t >= cut)
    assert seen(spark, path) == since(now - 60 * minute)
    assert len(reader.collect()) == every  # who started before sees all files
    # rows written to the day meanwhile are seen, the cut moves to the next day
    store.write_metrics(metrics(spark, [(now - minute, "n", "late", 1.0)]), path)
    later = now + 25 * minute
    did = store.retain_store(spark, path, later, 60)
    assert did["days"] == 1 and did["writes"] == 2  # 1970-01-01 of metric a; the first write of the edge, by metric
    assert seen(spark, path) == sorted([*since(later - 60 * minute), (now - minute, "late", 1.0)])
    last = store.retain_store(spark, path, later + 60 * minute, 60)
    assert seen(spark, path) == []
    assert last["days"] == 2
    on_disk = [d.name for m in shared.File(spark, path).children() if m.name.startswith("metric=") for d in m.children()]
    assert set(on_disk) == {"bucket_date=1970-01-03"}
    with pytest.raises(ValueError):
        store.retain_store(spark, path, now, 61)
    assert store.retain_store(spark, f"file://{tmp_path}/nowhere", now, 5) == {"days": 0, "rewritten": 0, "writes": 0}


def test_responses_of_a_large_node(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("n").alias("node_id"), (F.col("id") % 400).cast("string").alias("shard"), F.col("id").alias("bucket"))
    df = df.unionByName(spark.createDataFrame([(None, "x", 5)], "node_id string, shard string, bucket long"))
    got = [(r["node_id"], json.loads(r["response"])) for r in store.to_response(df, ["shard"], most=100).collect()]
    sizes = [len(x["data"]["records"]) for n, x in got if n == "hot"]
    assert sum(sizes) == 990 and max(sizes) <= 100 and {x["timestamp"] for n, x in got if n == "hot"} == {989}
    assert all(x["data"]["records"] == sorted(x["data"]["records"]) for _, x in got)
    assert sorted(len(x["data"]["records"]) for n, x in got if n != "hot") == [1, 10]
