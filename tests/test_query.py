import json

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import config, query, shape
from tidemark.schemas import FAMILIES, MetricSpec
from tidemark.sources import shared, store


@pytest.fixture()
def metrics(spark):
    data = [(0, "n1", "a", 1, 1.0), (0, "n1", "b", 1, 5.0), (0, "n1", "a", None, 3.0), (5000, "n2", "a", 2, 7.0)]
    return spark.createDataFrame(data, "bucket long, node_id string, metric string, shard_id long, value double")


def test_metrics_side_by_side(metrics):
    found = {r["shard_id"]: (r["a"], r["b"]) for r in query.query_metrics(metrics, ["a", "b"], ["sum", "max"], ["shard_id"]).collect()}
    assert found == {1: (1.0, 5.0), None: (3.0, None), 2: (7.0, None)}
    assert [tuple(r) for r in query.query_metrics(metrics, ["a"], ["avg"]).collect()] == [(11 / 3,)]
    assert query.query_metrics(metrics, ["z"], ["avg"]).collect()[0][0] is None
    for bad in ((["a", "b"], ["sum"]), (["a"], ["median"])):
        with pytest.raises(ValueError):
            query.query_metrics(metrics, *bad)


def test_nodes_and_latest(metrics):
    assert {r["node_id"] for r in query.query_nodes(metrics, ["a"], ["sum"], nodes="all").collect()} == {"n1", "n2"}
    assert {r["node_id"] for r in query.query_nodes(metrics, ["a"], ["sum"], local_id="n2").collect()} == {"n2"}
    assert query.latest(metrics).count() == 4
    assert query.latest(metrics, now=9_999).count() == 3 and query.latest(metrics, now=10_000).count() == 4 and query.latest(metrics, now=4_999).count() == 0


def test_batches_take_the_first_bucket_of_each_part(spark):
    store_ = spark.createDataFrame([(b, "n", "a", 1.0) for b in (905_000, 910_000, 920_000, 930_000)], "bucket long, node_id string, metric string, value double")
    found = query.query_batch(store_, ["a"], 901_000, 931_000, 10, now=1_000_000)
    assert sorted(r["bucket"] for r in found.collect()) == [905_000, 910_000, 920_000]
    for start, end, period in ((901_000, 931_000, 7), (901_000, 931_000, 0), (901_000, 903_000, 5), (1, 931_000, 5), (901_000, 1_000_001, 5), (901_000, 931_000, 420)):
        with pytest.raises(ValueError):
            query.query_batch(store_, ["a"], start, end, period, now=1_000_000)


def test_results_above_the_cap_are_errors(spark):
    assert query.cap_points(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        query.cap_points(spark.range(4), 3)


def test_counts_of_errors_and_tasks(spark):
    log = spark.createDataFrame([("A",), (None,), ("A",)], "code string")
    assert {tuple(r) for r in query.error_counts(log).collect()} == {("A", 2), ("OTHER", 1), ("TOTAL", 3)}
    assert query.pending_tasks(spark.createDataFrame([], "source string")).count() == 0


def test_overrides_keep_the_last_mention(spark):
    side = "struct<rcas:array<string>,deciders:array<string>,actions:array<string>,collectors:array<string>>"
    none = (None, None, None, None)
    data = [
        ("c", 1, 1, (["3", "4"], None, None, None), (["1", "2"], None, None, None)),
        ("c", 2, 2, (["1"], None, None, None), none),
        ("c", 3, 3, (["2"], None, None, None), (["2"], None, None, None)),
        ("c", 4, 4, none, none),
    ]
    df = spark.createDataFrame(data, f"cluster_id string, ts long, seq long, enable {side}, disable {side}")
    assert [tuple(r) for r in config.fold_overrides(df).collect()] == [("c", "rcas", ["1", "3", "4"], ["2"])]
    assert [tuple(r) for r in config.fold_overrides(df, as_of=1).collect()] == [("c", "rcas", ["3", "4"], ["1", "2"])]


def test_features_are_not_switched_on_while_the_pipeline_is_off(spark):
    df = spark.createDataFrame([("c", t, t, s) for t, s in enumerate([14, 15, 9, 2, 8])], "cluster_id string, ts long, seq long, state int")
    found = {}
    for r in config.fold_feature_state(df).collect():
        if r["enabled"]:
            found.setdefault(r["from_ms"], set()).add(r["feature"])
    assert found == {1: {"pipeline", "rca", "logging", "batch"}, 2: {"pipeline", "batch"}}


def test_details_of_nodes(spark):
    df = spark.createDataFrame([("1", "h1", True, True), ("2", "h2", False, True), ("3", "h3", False, False), ("1", "h1", True, True)], "id string, host_address string, is_data boolean, is_master_eligible boolean")
    assert sorted(tuple(r) for r in shape.node_details(df, "1", "2").collect()) == [("1", "h1", "DATA", False, 0), ("2", "h2", "MASTER", True, 1), ("3", "h3", "UNKNOWN", False, 1)]


def test_shards_without_a_node_have_an_empty_name(spark):
    routing = spark.createDataFrame([("i", 0, True, "1", "STARTED"), ("i", 1, False, None, "UNASSIGNED"), ("i", 2, True, "1", "RELOCATING")], "index_name string, shard_id int, is_primary boolean, node_id string, state string")
    nodes = spark.createDataFrame([("1", "one")], "node_id string, node_name string")
    assert sorted(tuple(r) for r in shape.inactive_shards(routing, nodes).collect()) == [("i", 1, "replica", "", "UNASSIGNED"), ("i", 2, "primary", "one", "RELOCATING")]
    assert shape.inactive_shards(routing.filter("state = 'STARTED'"), nodes).count() == 0


def test_pressure_has_a_row_per_stage(spark):
    names = "index_name string, shard_id int, shared_limit long, replica_limit long" + "".join(f", {s}_{c} long" for s in ("coordinating", "primary", "replica") for c in ("rejections", "bytes", "average_bits", "success_ms"))
    bits = 4609434218613702656  # 1.5
    df = spark.createDataFrame([("i", 0, 10, 20, 1, 2, bits, 3, 4, 5, bits, 6, 7, 8, bits, 9)], names)
    found = {r["stage"]: (r["rejections"], r["limit_bytes"], r["average"]) for r in shape.indexing_pressure(df).collect()}
    assert found == {"coordinating": (1, 10, 1.5), "primary": (4, 10, 1.5), "replica": (7, 20, 1.5)}


def test_long_metrics_leave_out_nulls(spark):
    df = spark.createDataFrame([(0, "n", "x", None), (0, "n", "y", 7)], "bucket long, node_id string, type string, max_size long")
    assert [tuple(r) for r in shape.family_metrics(df, FAMILIES["cache_config"]).collect()] == [(0, "n", "y", "max_size", 7.0)]
    spec = MetricSpec("half", "max_size / 2", ("type",))
    assert [r["value"] for r in shape.to_metrics(df, ["type"], [spec]).collect()] == [3.5]
    with pytest.raises(ValueError):
        MetricSpec("m", "1", (), kind="timer")


def test_small_functions(spark):
    df = spark.createDataFrame([("create-index [a]", "STARTED", 5, 2), ("x", None, 5, 2), ("", "CLOSED", None, 2)], "s string, state string, w long, r long")
    found = df.select(fn.task_type(F.col("s")), fn.task_metadata(F.col("s")), fn.index_buffer_bytes(F.col("state"), F.col("w"), F.col("r"))).collect()
    assert [tuple(r) for r in found] == [("create-index", " [a]", 7), ("x", "", 0), ("", "", 0)]
    assert spark.range(1).select(fn.bucket(F.lit(12500), 5000), fn.bucket(F.lit(-1), 5000)).first()[:] == (10000, -5000)


def test_store_and_responses(spark, metrics, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_metrics(metrics, path)
    store.write_metrics(metrics.filter("metric = 'b'"), path, replace=True)
    back = store.read_metrics(spark, path, 0, 5000)
    assert sorted((r["metric"], r["value"]) for r in back.collect()) == [("a", 1.0), ("a", 3.0), ("b", 5.0)]
    assert store.retain(metrics, 5000 + 60_000, 1).count() == 1
    for minutes in (0, 61):
        with pytest.raises(ValueError):
            store.retain(metrics, 0, minutes)
    found = {r["node_id"]: json.loads(r["response"]) for r in store.to_response(metrics, ["metric", "value"]).collect()}
    assert found["n2"] == {"data": {"fields": [{"name": "metric", "type": "VARCHAR"}, {"name": "value", "type": "DOUBLE"}], "records": [["a", "7.0"]]}, "timestamp": 5000}
    assert json.loads(store.rows_json(metrics.filter("shard_id IS NULL")).first()[0]) == {"bucket": 0, "node_id": "n1", "metric": "a", "value": 3.0}


def test_running_buckets_are_held_back(spark, metrics, tmp_path):
    path = f"file://{tmp_path}/store"
    rest = store.write_metrics(metrics, path, now=7_000)
    assert [r["bucket"] for r in rest.collect()] == [5000]
    assert {r["bucket"] for r in store.read_metrics(spark, path).collect()} == {0}
    assert store.write_metrics(rest, path, now=10_000).count() == 0
    assert store.read_metrics(spark, path).count() == 4


def test_a_large_node_has_several_responses(spark):
    df = spark.range(10).select(F.lit("n").alias("node_id"), (F.col("id") * 10).alias("bucket"), "id")
    found = [json.loads(r["response"]) for r in store.to_response(df, ["id"], most=4).collect()]
    assert sorted(len(f["data"]["records"]) for f in found) == [2, 4, 4] and {f["timestamp"] for f in found} == {90}
    assert sorted(float(r[0]) for f in found for r in f["data"]["records"]) == list(range(10))


def test_batches_above_the_cap_are_errors(spark, monkeypatch):
    store_ = spark.createDataFrame([(905_000, "n", "a", float(i)) for i in range(5)], "bucket long, node_id string, metric string, value double")
    monkeypatch.setattr(query.cap_points, "__defaults__", (4,))
    with pytest.raises(ValueError):
        query.query_batch(store_, ["a"], 901_000, 931_000, 10, now=1_000_000)


def test_stored_tables_can_be_dropped(spark):
    path = shared.new_path(spark, "numbers")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert shared.drop_made(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
