"""Telemetry tables derived from the given ones, with one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_EV = """SELECT event_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, user_id, event_type, value,
    CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}"""
DUCK_EV = """SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""

#: name: (tables it reads, SQL)
VIEWS = {
    "op_start": "SELECT event_id AS op_id, 'n' || (user_id % 3) AS node_id, user_id % 16 AS thread_id, event_type AS op, 'idx' || (user_id % 5) AS index_name, k % 4 AS shard_id, ms AS start_ms, k AS items FROM {ev} WHERE event_id % 11 <> 5",
    "op_finish": "SELECT event_id AS op_id, 'n' || (user_id % 3) AS node_id, user_id % 16 AS thread_id, event_type AS op, ms + CAST(floor(value * 1000) AS BIGINT) AS finish_ms, event_id % 7 = 0 AS failed FROM {ev} WHERE event_id % 10 <> 3",
    "counters": "SELECT event_id AS seq, event_type AS name, ms, CAST((sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id)) % 5000 AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS cnt FROM {ev}",
    "polls": "SELECT event_id AS seq, 'n' || (user_id % 3) AS node_id, ms AS poll_ms, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(event_id / 3) AS BIGINT) END AS head_order, event_type || ' [' || k || ']' AS source, k * 10 AS age_ms FROM {ev}",
    "thread_samples": "SELECT event_id AS seq, 'n' || (user_id % 3) AS node_id, user_id % 16 AS thread_id, ms AS sample_ms, value / 500 AS cpu FROM {ev}",
    "metrics": "SELECT ms - ms % 3600000 AS bucket, 'n' || (user_id % 3) AS node_id, event_type AS metric, k % 4 AS shard_id, value FROM {ev}",
    "http_start": "SELECT event_id AS id, 'n' || (user_id % 3) AS node_id, CASE WHEN event_id % 2 = 0 THEN 'bulk' ELSE 'search' END AS kind, ms AS start_ms, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'idx' || (user_id % 5) || ',idx' || (user_id % 3) END AS indices, CASE WHEN event_id % 2 = 0 THEN k ELSE 0 END AS items FROM {ev} WHERE event_id % 11 <> 5",
    "http_finish": "SELECT event_id AS id, 'n' || (user_id % 3) AS node_id, CASE WHEN event_id % 2 = 0 THEN 'bulk' ELSE 'search' END AS kind, ms + CAST(floor(value * 1000) AS BIGINT) AS finish_ms, CASE WHEN event_id % 7 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 7 = 0 THEN 'TimeoutException' ELSE '' END AS exception FROM {ev} WHERE event_id % 10 <> 3",
    "fault_events": "SELECT CASE WHEN event_id % 2 = 0 THEN 'follower_check' ELSE 'leader_check' END AS type, event_id AS request_id, 'n' || (user_id % 3) AS source_node, 'n' || (k % 3) AS target_node, ms AS start_ms, CAST(NULL AS BIGINT) AS finish_ms, CAST(NULL AS BOOLEAN) AS fault FROM {ev} WHERE event_id % 11 <> 5 UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'follower_check' ELSE 'leader_check' END, event_id, 'n' || (user_id % 3), 'n' || (k % 3), CAST(NULL AS BIGINT), ms + CAST(floor(value * 1000) AS BIGINT), event_id % 7 = 0 FROM {ev} WHERE event_id % 10 <> 3",
    "replies": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'bulk' WHEN 1 THEN 'search' ELSE 'other' END AS kind, CASE WHEN event_id % 7 = 0 THEN 'failure' ELSE 'response' END AS outcome, CASE WHEN event_id % 14 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 500 ELSE 200 END AS code, CASE WHEN event_id % 7 = 0 THEN 'TimeoutException' END AS exception FROM {ev}",
    "requests": "SELECT event_id AS id, CASE k % 3 WHEN 0 THEN 'a.Outer$ConcreteShardRequest' WHEN 1 THEN 'a.Outer$ConcreteReplicaRequest' ELSE 'a.OtherRequest' END AS request_class, CASE WHEN user_id % 2 = 0 THEN 'a.BulkShardRequest' ELSE 'a.OtherRequest' END AS inner_class FROM {ev}",
    "shards": "SELECT event_id AS id, CASE k % 5 WHEN 0 THEN 'RECOVERING' WHEN 1 THEN 'POST_RECOVERY' WHEN 2 THEN 'STARTED' WHEN 3 THEN 'CLOSED' END AS state, k * 100 AS writing, user_id * 10 AS ram FROM {ev}",
    "ip_counters": "SELECT event_id AS seq, 'n' || (user_id % 3) AS node_id, ms, event_id * 3 + k AS in_packets, event_id * 2 + k % 7 AS in_delivers, event_id * 100 AS in_bytes, event_id * 4 AS out_packets, event_id + k % 5 AS out_discards, k AS out_no_routes, event_id * 90 + k AS out_bytes FROM {ev}",
    "tcp_flows": "SELECT 'd' || (user_id % 10) AS dest, k AS tx_queue, k % 7 AS rx_queue, k % 3 AS lost, k * 2 AS send_cwnd, user_id AS ssthresh FROM {ev}",
    "state_history": "SELECT 'c' || (user_id % 3) AS cluster_id, ms AS ts, event_id AS seq, CAST(k % 16 AS INT) AS state FROM {ev}",
    "cluster_events": "SELECT event_id, 'c' || (user_id % 3) AS cluster_id, ms, value FROM {ev}",
    "error_log": "SELECT event_id, ms AS ts, CASE WHEN k % 5 = 0 THEN NULL ELSE event_type END AS code FROM {ev}",
    "stage_log": "SELECT event_type AS collector, CASE WHEN k % 2 = 0 THEN 'execution_ms' ELSE 'errors' END AS stat, CAST(floor(value) AS BIGINT) AS value FROM {ev}",
    "overrides": "SELECT 'c' || (user_id % 3) AS cluster_id, ms AS ts, event_id AS seq, CAST(user_id % 4 AS INT) AS kind, 'x' || (k % 10) AS component, k % 2 = 0 AS enabled, event_id % 7 = 0 AS two_sided FROM {ev}",
    "switches": "SELECT 'c' || (user_id % 3) AS cluster_id, ms AS ts, event_id AS seq, 3 AS kind, 'x' || (user_id % 7) AS component, k % 2 = 0 AS enabled, event_id % 7 = 0 AS two_sided FROM {ev}",
    "units": "SELECT DISTINCT event_type AS metric, CASE WHEN event_type = 'error' THEN 'count' ELSE 'ms' END AS unit FROM {ev} WHERE event_type <> 'view'",
    "nodes": "SELECT CAST(s_suppkey AS STRING) AS id, s_name AS host_address, s_nationkey % 2 = 0 AS is_data, s_nationkey % 3 = 0 AS is_master_eligible FROM {supplier}",
    "node_names": "SELECT CAST(s_suppkey AS STRING) AS node_id, s_name AS node_name FROM {supplier} WHERE s_suppkey < 100",
    "node_keys": "SELECT s_nationkey AS node, s_suppkey AS key FROM {supplier}",
    "routing": "SELECT p_brand AS index_name, p_partkey AS shard_id, p_partkey % 2 = 0 AS is_primary, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 120 AS STRING) END AS node_id, CASE p_size % 4 WHEN 0 THEN 'STARTED' WHEN 1 THEN 'INITIALIZING' WHEN 2 THEN 'UNASSIGNED' ELSE 'RELOCATING' END AS state FROM {part}",
    "trackers": "SELECT p_brand AS snapshot, p_partkey AS shard_id, CAST(floor(p_retailprice) AS BIGINT) AS bytes FROM {part}",
    "pending": "SELECT o_orderpriority || ' [' || o_orderkey || ']' AS source FROM {orders}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "ev":
        return spark.sql(SPARK_EV, events=table("events"))
    sql = VIEWS[name]
    reads = {t: view(spark, sf_dir, "ev") if t == "ev" else table(t) for t in ("ev", "supplier", "part", "orders") if f"{{{t}}}" in sql}
    return spark.sql(sql, **reads)


def duck(names: str, query: str) -> str:
    """DuckDB SQL: the named views, and a query over them that may begin with further ones after a comma."""
    parts = []
    for name in ["ev", *names.split()]:
        parts.append(f"{name} AS ({DUCK_EV if name == 'ev' else VIEWS[name].format(ev='ev', supplier='supplier', part='part', orders='orders')})")
    query = query.strip()
    return f"WITH {', '.join(parts)}{'' if query.startswith(',') else ' '}{query}"
