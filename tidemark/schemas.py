"""Families of samples and events: explicit schemas and the metrics that each gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class MetricSpec:
    """A metric: its name, a Spark SQL expression for its value, its dimensions, unit and kind (gauge or counter)."""

    name: str
    value_expr: str
    dims: tuple[str, ...]
    unit: str = "count"
    kind: str = "gauge"

    def __post_init__(self) -> None:
        if self.kind not in ("gauge", "counter"):
            raise ValueError(f"kind of {self.name} must be gauge or counter, not {self.kind}")


@dataclass(frozen=True)
class Family:
    """Samples of one kind: dimensions and values by name and SQL type."""

    name: str
    dims: dict[str, str]
    values: dict[str, str]
    units: dict[str, str] = field(default_factory=dict)
    #: Values that only grow; all others are gauges.
    counters: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(n, kinds[t]) for n, t in (self.dims | self.values).items()])

    @property
    def metrics(self) -> list[MetricSpec]:
        return [MetricSpec(n, f"CAST({n} AS DOUBLE)", tuple(self.dims), self.units.get(n, "count"), "counter" if n in self.counters else "gauge") for n in self.values]


def _longs(names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), "bigint")


_SHARD = {"index_name": "string", "shard_id": "int"}

FAMILIES = {
    f.name: f
    for f in (
        Family("thread_pool", {"type": "string"}, {"queue_size": "int", "rejected": "bigint", "threads": "int", "active": "int", "queue_latency": "double", "queue_capacity": "int"}, {"queue_latency": "ms"}, ("rejected",)),
        Family("circuit_breaker", {"type": "string"}, _longs("estimated tripped limit"), {"estimated": "B", "limit": "B"}),
        Family("cache_config", {"type": "string"}, _longs("max_size"), {"max_size": "B"}),
        Family("admission_control", {"controller": "string"}, _longs("current threshold rejections")),
        Family("election_term", {}, _longs("term")),
        Family("throttling", {}, _longs("retrying throttled")),
        Family(
            "shard_cache", _SHARD, _longs("query_hit query_miss fielddata_evict request_hit request_miss request_evict query_bytes fielddata_bytes request_bytes"), dict.fromkeys(("query_bytes", "fielddata_bytes", "request_bytes"), "B"),
            ("query_hit", "query_miss", "fielddata_evict", "request_hit", "request_miss", "request_evict"),
        ),
        Family(
            "shard_stats",
            _SHARD,
            _longs(
                "indexing_throttle_time refresh_count refresh_time flush_count flush_time merge_count merge_time merge_current index_buffer segment_count segments_memory terms_memory "
                "stored_fields_memory term_vectors_memory norms_memory points_memory doc_values_memory index_writer_memory version_map_memory bitset_memory shard_size"
            ),
        ),
        Family("pressure", _SHARD | {"stage": "string"}, {"rejections": "bigint", "current_bytes": "bigint", "limit_bytes": "bigint", "average": "double", "last_success_ms": "bigint"}, {"current_bytes": "B", "limit_bytes": "B"}),
        Family("node_details", {"id": "string", "host_address": "string", "role": "string"}, {"is_master": "boolean"}),
        Family("publish_stats", {}, _longs("total_count time_ms failed"), {"time_ms": "ms"}, ("total_count", "time_ms", "failed")),
        Family("applier_stats", {}, _longs("total_count time_ms failed current_elapsed_ms"), {"time_ms": "ms", "current_elapsed_ms": "ms"}, ("total_count", "time_ms", "failed")),
        Family("shard_state", _SHARD | {"kind": "string", "node_name": "string"}, {"state": "string"}),
    )
}

#: Metrics of all families with their units.
UNITS = sorted({(m.name, m.unit) for f in FAMILIES.values() for m in f.metrics})

#: Keys of an event's path by family, in their order.
PATHS = {
    "shard_search": ("thread_id", "phase", "id", "edge"),
    "shard_bulk": ("thread_id", "id", "edge"),
    "http": ("kind", "id", "edge"),
    "master_task": ("thread_id", "task_id", "edge"),
    "master_pending": ("current", "pending"),
    "shard": ("index_name", "shard_id"),
    "fault": ("type", "request_id", "edge"),
}
