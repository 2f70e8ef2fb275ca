"""Projections, filters and reshaping of samples and cluster state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import double_from_bits
from ..schemas import Family, MetricSpec


def node_details(nodes: DataFrame, local_id: str, master_id: str) -> DataFrame:
    """From (id, host_address, is_data, is_master_eligible): role, is_master, and ordinal 0 for the local node, 1 for others."""
    role = F.when(F.col("is_data"), "DATA").when(F.col("is_master_eligible"), "MASTER").otherwise("UNKNOWN")
    return nodes.dropDuplicates(["id"]).select(
        "id",
        "host_address",
        role.alias("role"),
        F.coalesce(F.col("id") == F.lit(master_id), F.lit(False)).alias("is_master"),
        F.when(F.col("id") == F.lit(local_id), 0).otherwise(1).alias("ordinal"),
    )


def inactive_shards(routing: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shards that have not started, with the name of their node or the empty text. nodes: (node_id, node_name), one row each."""
    idle = routing.filter(F.coalesce(F.col("state"), F.lit("")) != "STARTED")
    return idle.join(nodes.select("node_id", "node_name"), "node_id", "left").select(
        "index_name", "shard_id", F.when(F.col("is_primary"), "primary").otherwise("replica").alias("kind"), F.coalesce("node_name", F.lit("")).alias("node_name"), "state"
    )


def response_status(replies: DataFrame) -> DataFrame:
    """Finish rows of replies (kind bulk, search or other; outcome response or failure; code, exception): status and exception.

    A failure without a code has status -1; replies of other kinds leave no row unless they failed.
    """
    failed = F.col("outcome") == "failure"
    kept = replies.filter(failed | F.col("kind").isin("bulk", "search"))
    return kept.withColumns({"status": F.coalesce("code", F.when(failed, -1)), "exception": F.when(failed, F.coalesce("exception", F.lit(""))).otherwise("")}).drop("code", "outcome")


def indexing_pressure(trackers: DataFrame) -> DataFrame:
    """One wide tracker per shard to a row per stage. The first two stages share a limit; averages are doubles as raw bits."""
    stages = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.col(f"{stage}_rejections").alias("rejections"),
            F.col(f"{stage}_bytes").alias("current_bytes"),
            F.col("replica_limit" if stage == "replica" else "shared_limit").alias("limit_bytes"),
            double_from_bits(F.col(f"{stage}_average_bits")).alias("average"),
            F.col(f"{stage}_success_ms").alias("last_success_ms"),
        )
        for stage in ("coordinating", "primary", "replica")
    ]
    return trackers.select("index_name", "shard_id", F.inline(F.array(*stages)))


def to_metrics(df: DataFrame, dims: Sequence[str], values: Sequence[str | MetricSpec], bucket_col: str = "bucket", node_col: str = "node_id") -> DataFrame:
    """Wide typed rows to long ones: bucket, node, dimensions, metric, value. Null values give no row."""
    specs = [v if isinstance(v, MetricSpec) else MetricSpec(v, f"CAST(`{v}` AS DOUBLE)", tuple(dims)) for v in values]
    made = df.select(bucket_col, node_col, *dims, *[F.expr(s.value_expr).cast("double").alias(s.name) for s in specs])
    return made.unpivot([bucket_col, node_col, *dims], [s.name for s in specs], "metric", "value").filter("value IS NOT NULL")


def family_metrics(df: DataFrame, family: Family, bucket_col: str = "bucket", node_col: str = "node_id") -> DataFrame:
    """to_metrics by a family's own metrics; booleans and numbers become doubles."""
    return to_metrics(df, list(family.dims), family.metrics, bucket_col, node_col)


# Classes of requests.
PRIMARY_REQUEST, REPLICA_REQUEST, BULK_REQUEST = "ConcreteShardRequest", "ConcreteReplicaRequest", "BulkShardRequest"


def shard_bulk_kind(requests: DataFrame) -> DataFrame:
    """Requests whose inner_class is a bulk shard request, with is_primary from request_class; names may be qualified."""
    outer, inner = (F.regexp_extract(c, r"[^.$]*$", 0) for c in ("request_class", "inner_class"))
    kept = outer.isin(PRIMARY_REQUEST, REPLICA_REQUEST) & (inner == BULK_REQUEST)
    return requests.filter(kept).withColumn("is_primary", outer == PRIMARY_REQUEST)
