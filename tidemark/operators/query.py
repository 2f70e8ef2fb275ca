"""Queries of the metric store: bucket, node_id, metric, dimensions, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unused
from ..sources.shared import new_path

AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
#: Rows that a batch query may return.
MAX_POINTS = 100_800


def query_metrics(store: DataFrame, metrics: Sequence[str], aggs: Sequence[str], dims: Sequence[str] = (), by_node: bool = False) -> DataFrame:
    """A row per tuple of dims and a column per metric, in one pass; null where a metric lacks the tuple. Without dims one row."""
    if len(metrics) != len(aggs):
        raise ValueError(f"{len(metrics)} metrics need as many aggregations, not {len(aggs)}")
    if unknown := set(aggs) - set(AGGREGATIONS):
        raise ValueError(f"unknown aggregations: {', '.join(sorted(unknown))}")
    keys = [*(["node_id"] if by_node else []), *[d for d in dims if d]]
    columns = [AGGREGATIONS[a](F.when(F.col("metric") == m, F.col("value"))).alias(m) for m, a in zip(metrics, aggs, strict=True)]
    return store.filter(F.col("metric").isin(*metrics)).groupBy(*keys).agg(*columns)


def latest(store: DataFrame, now: int | Column | None = None, interval_ms: int = 5000) -> DataFrame:
    """Rows of each node's last bucket; with now (milliseconds) of the last one that was complete by then."""
    if now is not None:
        store = store.filter(F.col("bucket") + interval_ms <= now)
    last = store.groupBy("node_id").agg(F.max("bucket").alias("bucket"))
    return store.join(last, ["node_id", "bucket"], "left_semi")


def query_nodes(store: DataFrame, metrics: Sequence[str], aggs: Sequence[str], dims: Sequence[str] = (), nodes: str = "local", local_id: str | None = None) -> DataFrame:
    """query_metrics by node: of all nodes if nodes is 'all', else of the local one."""
    own = store if nodes == "all" else store.filter(F.col("node_id") == F.lit(local_id))
    return query_metrics(own, metrics, aggs, dims, by_node=True)


def check_range(start: int, end: int, period_s: int, now: int, retention_min: int, least_s: int = 5) -> tuple[int, int]:
    """Start and end floored to the period, or an error. Times are in milliseconds."""
    retention = retention_min * 60_000
    if not 1 <= retention_min <= 60:
        raise ValueError("retention must be from 1 to 60 minutes")
    if period_s < least_s or period_s % least_s or period_s * 1000 >= retention:
        raise ValueError(f"the period must be a multiple of {least_s} s below the retention")
    if start < now - retention or end > now:
        raise ValueError("the range must lie within the retention and not in the future")
    start, end = (t - t % (period_s * 1000) for t in (start, end))
    if start >= end:
        raise ValueError("the start must lie before the end")
    return start, end


def query_batch(store: DataFrame, metrics: Sequence[str], start: int, end: int, period_s: int, now: int, retention_min: int = 7) -> DataFrame:
    """Rows in [start, end) of the first bucket that each part of a period has, by node and metric. More of them than MAX_POINTS are an error."""
    start, end = check_range(start, end, period_s, now, retention_min)
    return cap_points(sampled(store, metrics, start, end, period_s * 1000))


def sampled(store: DataFrame, metrics: Sequence[str], start: int, end: int, period_ms: int) -> DataFrame:
    """Per node, metric and part of a period the rows of its first bucket. Start and end are multiples of the period."""
    rows = store.filter(F.col("metric").isin(*metrics) & (F.col("bucket") >= start) & (F.col("bucket") < end))
    part = unused(store.columns, "__part")
    rows = rows.withColumn(part, F.floor((F.col("bucket") - start) / period_ms))
    first = rows.groupBy("node_id", "metric", part).agg(F.min("bucket").alias("bucket"))
    return rows.join(first, ["node_id", "metric", part, "bucket"], "left_semi").drop(part)


def cap_points(df: DataFrame, limit: int = MAX_POINTS) -> DataFrame:
    """The rows of df, or an error if there are more than limit. They are computed once, into the shared folder, and no further than that."""
    path = new_path(df.sparkSession, "points")
    df.limit(limit + 1).write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    if held.count() > limit:
        raise ValueError(f"the result has more than {limit} points")
    return held


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Waiting tasks by type, the text before the first space of their source."""
    return tasks.groupBy(F.substring_index("source", " ", 1).alias("task_type")).agg(F.count(F.lit(1)).alias("n"))


def error_counts(log: DataFrame) -> DataFrame:
    """Errors by code, OTHER for none, and a row TOTAL."""
    coded = log.select(F.coalesce("code", F.lit("OTHER")).alias("__code"))
    counted = coded.rollup("__code").agg(F.count(F.lit(1)).alias("n"), F.grouping("__code").alias("__all"))
    return counted.select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("__code")).alias("code"), "n")


def stage_stats(log: DataFrame) -> DataFrame:
    """Execution times and outcome counters by collector and stat: count, sum, avg, min, max."""
    v = F.col("value")
    return log.groupBy("collector", "stat").agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"))

