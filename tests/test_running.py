"""Running values cut into ranges equal those of one window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import config, correlate, counters, events
from tidemark.operators.running import CUT, in_ranges, running
from tidemark.plans import catalog
from tidemark.sources import logs


@pytest.fixture(scope="module")
def hot(spark):
    """A key with nine of ten rows, null keys, ties in time, nulls in values."""
    i = F.col("id")
    return spark.range(6000).select(
        F.when(i % 10 > 0, "hot").when(i % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 7)).alias("k"),
        F.when(i % 997 > 0, i * 7919 % 6000 - i * 7919 % 3).alias("t"), i.alias("seq"),
        F.when(i % 13 > 0, i * 31 % 1009).alias("v"), (i % 5 * i % 11).alias("n"),
    )


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_all_kinds(hot):
    v = F.col("v")
    kinds = {"before": {"b": v}, "upto": {"u": v, "x": F.when(v % 50 == 0, v)}, "after": {"a": v}, "sums": {"s": v}}
    got = running(hot, ["k"], ["t", "seq"], **kinds, ranges=16)
    by = Window.partitionBy("k").orderBy("t", "seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumns({
        "b": F.last("v", True).over(by.rowsBetween(Window.unboundedPreceding, -1)), "u": F.last("v", True).over(upto), "x": F.last(F.when(v % 50 == 0, v), True).over(upto),
        "a": F.lead("v").over(by), "s": F.coalesce(F.sum("v").over(upto), F.lit(0)),
    })
    same(got, want)
    same(running(hot, ["k"], ["t", "seq"], **kinds), want)


def test_a_hot_key_is_in_several_tasks(spark, hot):
    rows = running(hot, ["k"], ["t", "seq"], before={"b": F.col("v")}, ranges=8)
    spread = rows.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    stored = [f for f in rows.inputFiles()]
    parts = spark.read.parquet(*stored).filter("k = 'hot'").groupBy("__range").count().collect()
    assert len(parts) >= 7 and max(r["count"] for r in parts) < 2500


def test_empty_and_one_row(spark, hot):
    assert running(hot.limit(0), ["k"], ["t", "seq"], before={"b": F.col("v")}, ranges=4).count() == 0
    one = running(hot.filter("seq = 1"), ["k"], ["t", "seq"], before={"b": F.col("v")}, after={"a": F.col("v")}, sums={"s": F.col("v")}, ranges=4).first()
    assert (one["b"], one["a"], one["s"]) == (None, None, 31)


def test_operators_give_the_same(hot):
    for f in (
        lambda r: counters.delta_first_absolute(hot, ["k"], ["t", "seq"], ["v", "n"], ranges=r),
        lambda r: counters.delta_max_gap(hot, ["k"], "t", "v", 5, ["seq"], ranges=r),
        lambda r: counters.interval_mean(hot, ["k"], ["t", "seq"], "v", "n", ranges=r),
        lambda r: counters.interval_failures(hot, ["k"], ["t", "seq"], "v", ranges=r),
        lambda r: events.implicit_finish(hot.select("k", F.col("t").alias("start_ms"), F.col("seq").alias("op_id"), F.when(F.col("n") > 5, F.col("v")).alias("finish_ms")), ["k"], ranges=r),
        lambda r: events.poll_to_events(hot.select("k", F.col("t").alias("poll_ms"), "seq", F.when(F.col("n") > 2, F.floor(F.col("t") / 40)).alias("head_order"), F.lit("a b").alias("source")), node=["k"], ranges=r),
        lambda r: events.task_runs(events.poll_to_events(hot.select("k", F.col("t").alias("poll_ms"), "seq", F.when(F.col("n") > 2, F.floor(F.col("t") / 40)).alias("head_order"), F.lit("a b").alias("source")), node=["k"], ranges=r), ["k"], ranges=r),
        lambda r: correlate.align(hot, ["k"], "t", "v", 50, tiebreak=["seq"], ranges=r).withColumn("v", F.round("v", 6)),
        lambda r: logs.carry_headers(hot.withColumn("h", F.when(F.col("n") == 3, F.col("seq"))), ["t", "seq"], "h", ["k"], ranges=r),
        lambda r: config.fold_feature_state(hot.select(F.col("k").alias("cluster_id"), F.col("t").alias("ts"), "seq", F.col("n").cast("int").alias("state")), ranges=r),
    ):
        same(f(9), f(None))


def test_rates_of_a_hot_key(hot):
    names = ("in_packets", "in_delivers", "in_bytes", "out_packets", "out_discards", "out_no_routes", "out_bytes")
    wide = hot.select("k", "t", "seq", *[(F.col("v") * (i + 2)).alias(n) for i, n in enumerate(names)])
    same(counters.counter_rate(wide, ["k"], "t", ["seq"], ranges=5), counters.counter_rate(wide, ["k"], "t", ["seq"]))


def test_task_runs_of_hot_nodes_in_ranges_that_are_cut_once(spark, tmp_path):
    """No window of c8_task_runs goes over all polls of a node, and runs go on over the edges of ranges."""
    polls = spark.range(3000).select(
        F.col("id").alias("seq"), (F.col("id") * 7919 % 3000).alias("poll_ms"), F.when(F.col("id") % 5 == 0, "x").otherwise("hot").alias("node_id"),
        F.when(F.col("id") % 17 != 0, F.floor(F.col("id") / 3)).alias("head_order"), F.concat(F.lit("t"), F.col("id") % 4, F.lit(" [m]")).alias("source"), F.col("id").alias("age_ms"),
    )
    cut = events.poll_to_events(in_ranges(polls, ["node_id"], ["poll_ms", "seq"], 16), cut=CUT)
    plain = events.poll_to_events(polls)
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(cut.drop(CUT)) == rows(plain) and cut.select(CUT).distinct().count() > 8
    assert rows(events.task_runs(cut, cut=CUT)) == rows(events.task_runs(plain))
    plan = catalog.QUERIES["c8_task_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(f"[{CUT}#" in line or "[__k0#" in line for line in windows)
