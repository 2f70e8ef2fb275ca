"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import streaming
from ..operators import config, correlate, counters, events, query, sampling, shape
from ..operators.running import CUT, in_ranges
from ..schemas import FAMILIES, Family, MetricSpec
from ..sources import logs, store
from ..sources.shared import new_path
from .views import duck, view

HOUR, DAY = 3_600_000, 86_400_000
#: Largest time that the batch queries ask for, and the range before it.
RANGE = (1_704_067_200_000, 1_706_659_200_000)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(views: str | None = None, sql: str | None = None):
    """Registers a query by its function's name, and its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(views or "", sql)
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean latency and items of shard operations, as a query of the metric store."""
    found = events.shard_op_metrics(view(spark, sf_dir, "op_start"), view(spark, sf_dir, "op_finish"), HOUR)
    made = found.withColumn("node_id", F.lit("all"))
    long = shape.to_metrics(made, ["op", "index_name", "shard_id"], ["latency_avg", "items"])
    return query.query_metrics(long, ["latency_avg", "items"], ["avg", "sum"], ["index_name", "shard_id"])


PAIRED = ", pair AS (SELECT s.*, f.finish_ms, f.failed, f.finish_ms - s.start_ms AS latency_ms FROM op_start s JOIN op_finish f ON s.node_id = f.node_id AND s.thread_id = f.thread_id AND s.op = f.op AND s.op_id = f.op_id AND f.finish_ms >= s.start_ms)"


# --- B: projections, filters, reshaping


@registered("", f"SELECT event_id, ms - ms % {HOUR} AS bucket FROM ev")
def b1_bucket(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("event_id", fn.bucket(F.col("ms"), HOUR).alias("bucket"))


@registered("pending", "SELECT source, split_part(source, ' ', 1) AS task_type, CASE WHEN instr(source, ' ') = 0 THEN '' ELSE substr(source, instr(source, ' ')) END AS metadata FROM pending")
def b2_split_task_source(spark, sf_dir):
    source = F.col("source")
    return view(spark, sf_dir, "pending").select("source", fn.task_type(source).alias("task_type"), fn.task_metadata(source).alias("metadata"))


@registered("nodes", "SELECT DISTINCT id, host_address, CASE WHEN is_data THEN 'DATA' WHEN is_master_eligible THEN 'MASTER' ELSE 'UNKNOWN' END AS role, id = '2' AS is_master, CASE WHEN id = '1' THEN 0 ELSE 1 END AS ordinal FROM nodes")
def b3_node_details(spark, sf_dir):
    return shape.node_details(view(spark, sf_dir, "nodes"), "1", "2")


@registered("routing node_names", "SELECT index_name, shard_id, CASE WHEN is_primary THEN 'primary' ELSE 'replica' END AS kind, coalesce(node_name, '') AS node_name, state FROM routing r LEFT JOIN node_names n ON r.node_id = n.node_id WHERE state <> 'STARTED'")
def b4_inactive_shards(spark, sf_dir):
    return shape.inactive_shards(view(spark, sf_dir, "routing"), view(spark, sf_dir, "node_names"))


@registered("replies", "SELECT id, kind, CASE WHEN outcome = 'failure' THEN coalesce(code, -1) ELSE code END AS status, coalesce(exception, '') AS exception FROM replies WHERE outcome = 'failure' OR kind <> 'other'")
def b5_response_status(spark, sf_dir):
    return shape.response_status(view(spark, sf_dir, "replies")).select("id", "kind", "status", "exception")


@registered("", """, s AS (SELECT unnest([0, 1, 2]) AS i)
    SELECT p_brand AS index_name, p_partkey AS shard_id, ['coordinating', 'primary', 'replica'][i + 1] AS stage, p_size + i AS rejections, floor(p_retailprice)::BIGINT + i AS current_bytes,
        floor(p_retailprice)::BIGINT * (CASE i WHEN 2 THEN 2 ELSE 4 END) AS limit_bytes, p_retailprice AS average, p_size * 1000 AS last_success_ms FROM part, s""")
def b6_indexing_pressure(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("p_retailprice")).cast("long")
    size, n = F.floor("p_retailprice").cast("long"), F.col("p_size").cast("long")
    wide = parts.select(
        F.col("p_brand").alias("index_name"), F.col("p_partkey").alias("shard_id"), (size * 4).alias("shared_limit"), (size * 2).alias("replica_limit"),
        *[c.alias(f"{s}_{x}") for i, s in enumerate(("coordinating", "primary", "replica")) for x, c in (("rejections", n + i), ("bytes", size + i), ("average_bits", bits), ("success_ms", n * 1000))],
    )
    return shape.indexing_pressure(wide)


_IO = Family("io", {"dest": "string"}, dict.fromkeys(("tx_queue", "rx_queue", "lost", "send_cwnd", "ssthresh"), "bigint"))


@registered("tcp_flows", ", w AS (SELECT 0::BIGINT AS bucket, 'n0' AS node_id, * FROM tcp_flows) SELECT bucket, node_id, dest, metric, value::DOUBLE AS value FROM (UNPIVOT w ON tx_queue, rx_queue, lost, send_cwnd, ssthresh INTO NAME metric VALUE value)")
def b7_to_metrics(spark, sf_dir):
    wide = view(spark, sf_dir, "tcp_flows").withColumns({"bucket": F.lit(0).cast("long"), "node_id": F.lit("n0")})
    return shape.family_metrics(wide, _IO)


@registered("", """, w AS (SELECT ms - ms % 3600000 AS bucket, 'n' || (user_id % 3) AS node_id, event_type AS type, k AS estimated, CASE WHEN k % 2 = 0 THEN user_id END AS tripped, event_id AS "limit" FROM ev)
    SELECT bucket, node_id, type, metric, value::DOUBLE AS value FROM (UNPIVOT w ON estimated, tripped, "limit" INTO NAME metric VALUE value)
    UNION ALL SELECT bucket, node_id, type, 'room', "limit" - estimated FROM w""")
def j1_declared_metrics(spark, sf_dir):
    """The metrics of a declared family, and one by an expression of its own."""
    ev = view(spark, sf_dir, "ev")
    wide = ev.select(
        fn.bucket(F.col("ms"), HOUR).alias("bucket"), F.concat(F.lit("n"), F.col("user_id") % 3).alias("node_id"), F.col("event_type").alias("type"), F.col("k").alias("estimated"),
        F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("tripped"), F.col("event_id").alias("limit"),
    )
    family = FAMILIES["circuit_breaker"]
    return shape.to_metrics(wide, list(family.dims), [*family.metrics, MetricSpec("room", "CAST(limit - estimated AS DOUBLE)", tuple(family.dims))])


@registered("shards", "SELECT id, CASE WHEN state IN ('RECOVERING', 'POST_RECOVERY', 'STARTED') THEN writing + ram ELSE 0 END AS bytes FROM shards")
def b8_index_buffer_bytes(spark, sf_dir):
    return view(spark, sf_dir, "shards").select("id", fn.index_buffer_bytes(F.col("state"), F.col("writing"), F.col("ram")).alias("bytes"))


@registered("requests", "SELECT *, request_class LIKE '%ConcreteShardRequest' AS is_primary FROM requests WHERE request_class LIKE '%Concrete%' AND inner_class LIKE '%BulkShardRequest'")
def b9_shard_bulk_kind(spark, sf_dir):
    return shape.shard_bulk_kind(view(spark, sf_dir, "requests"))


# --- C: pairing of events


@registered("op_start op_finish", f"{PAIRED} SELECT * FROM pair")
def c1_pair_events(spark, sf_dir):
    return events.pair_events(view(spark, sf_dir, "op_start"), view(spark, sf_dir, "op_finish"))


STATES = """, both_sides AS (
    SELECT s.op_id AS s_id, f.op_id AS f_id, s.start_ms, (SELECT max(ms) FROM ev) AS now FROM op_start s
    FULL OUTER JOIN op_finish f ON s.node_id = f.node_id AND s.thread_id = f.thread_id AND s.op = f.op AND s.op_id = f.op_id AND f.finish_ms >= s.start_ms)
    SELECT coalesce(s_id, f_id) AS op_id, CASE WHEN s_id IS NULL THEN 'orphan_finish' WHEN f_id IS NOT NULL THEN 'complete' WHEN start_ms >= now - 600000 THEN 'in_flight' ELSE 'expired' END AS state FROM both_sides"""


@registered("op_start op_finish", STATES)
def c2_classify_pairs(spark, sf_dir):
    now = view(spark, sf_dir, "ev").agg(F.max("ms")).first()[0]
    return events.classify_pairs(view(spark, sf_dir, "op_start"), view(spark, sf_dir, "op_finish"), now).select("op_id", "state")


@registered("op_start op_finish", f", c AS ({STATES.replace(', both_sides', 'WITH both_sides', 1)}) SELECT state, count(*) AS n FROM c GROUP BY state")
def c2_pair_counts(spark, sf_dir):
    return events.pair_counts(c2_classify_pairs(spark, sf_dir))


@registered("op_start op_finish", ", o AS (SELECT s.node_id, s.thread_id, s.op_id, s.start_ms, f.finish_ms FROM op_start s LEFT JOIN op_finish f ON s.op_id = f.op_id) SELECT *, finish_ms_ - start_ms AS latency_ms FROM (SELECT node_id, thread_id, op_id, start_ms, coalesce(finish_ms, lead(start_ms) OVER (PARTITION BY node_id, thread_id ORDER BY start_ms, op_id)) AS finish_ms_ FROM o)".replace("SELECT *, finish_ms_", "SELECT node_id, thread_id, op_id, start_ms, finish_ms_ AS finish_ms, finish_ms_"))
def c3_implicit_finish(spark, sf_dir):
    ops = view(spark, sf_dir, "op_start").join(view(spark, sf_dir, "op_finish").select("op_id", "finish_ms"), "op_id", "left")
    return events.implicit_finish(ops.select("node_id", "thread_id", "op_id", "start_ms", "finish_ms"))


LATENCY = "count(*) AS n, sum(items)::BIGINT AS items, sum(latency_ms)::BIGINT AS latency_sum, avg(latency_ms) AS latency_avg, min(latency_ms) AS latency_min, max(latency_ms) AS latency_max"


@registered("http_start http_finish", f", p AS (SELECT s.*, f.finish_ms, f.status, f.exception, finish_ms - start_ms AS latency_ms FROM http_start s JOIN http_finish f USING (node_id, kind, id) WHERE finish_ms >= start_ms) SELECT finish_ms - finish_ms % {DAY} AS bucket, kind, indices, status, exception, {LATENCY} FROM p GROUP BY ALL")
def c4_http_metrics(spark, sf_dir):
    return events.http_metrics(view(spark, sf_dir, "http_start"), view(spark, sf_dir, "http_finish"), DAY)


@registered("op_start op_finish", f"{PAIRED} SELECT finish_ms - finish_ms % {HOUR} AS bucket, op, index_name, shard_id, {LATENCY}, sum(failed::INT)::BIGINT AS failures, sum(failed::INT) / count(*) AS failure_rate FROM pair GROUP BY ALL")
def c5_shard_op_metrics(spark, sf_dir):
    return events.shard_op_metrics(view(spark, sf_dir, "op_start"), view(spark, sf_dir, "op_finish"), HOUR)


@registered("fault_events", f", p AS (SELECT s.type, s.source_node, s.target_node, s.start_ms, f.finish_ms, f.fault FROM fault_events s JOIN fault_events f ON s.type = f.type AND s.request_id = f.request_id WHERE s.start_ms IS NOT NULL AND f.start_ms IS NULL AND f.finish_ms >= s.start_ms) SELECT finish_ms - finish_ms % {DAY} AS bucket, type, source_node, target_node, count(*) AS n, avg(finish_ms - start_ms) AS latency_avg, sum(fault::INT)::BIGINT AS faults FROM p GROUP BY ALL")
def c6_fault_metrics(spark, sf_dir):
    return events.fault_metrics(view(spark, sf_dir, "fault_events"), DAY)


POLLED = """, h AS (SELECT *, coalesce(head_order, -1) AS head FROM polls),
    b AS (SELECT *, lag(head, 1, -1) OVER (PARTITION BY node_id ORDER BY poll_ms, seq) AS before FROM h),
    c AS (SELECT *, (sum((head <> -1)::INT) OVER (PARTITION BY node_id ORDER BY poll_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS starts FROM b WHERE head <> before),
    e AS (
        SELECT node_id, seq, poll_ms - 500 AS time_ms, 'finish' AS event, before AS task, starts - (head <> -1)::INT AS run, NULL AS task_type, NULL AS metadata, NULL AS age_ms FROM c WHERE before <> -1
        UNION ALL
        SELECT node_id, seq, poll_ms - 500, 'start', head, starts, split_part(source, ' ', 1), CASE WHEN instr(source, ' ') = 0 THEN '' ELSE substr(source, instr(source, ' ')) END, age_ms FROM c WHERE head <> -1
    )"""


@registered("polls", f"{POLLED} SELECT * FROM e")
def c7_poll_to_events(spark, sf_dir):
    return events.poll_to_events(view(spark, sf_dir, "polls"))


@registered("polls", f"{POLLED} SELECT s.task_type, count(*) AS n, sum(f.time_ms - s.time_ms)::BIGINT AS run_ms, sum(s.age_ms)::BIGINT AS queue_ms FROM e s JOIN e f USING (node_id, task, run) WHERE s.event = 'start' AND f.event = 'finish' AND f.time_ms >= s.time_ms GROUP BY ALL")
def c8_task_runs(spark, sf_dir):
    """A node has a third of all polls: they are cut into ranges once, for all passes along them."""
    polls = in_ranges(view(spark, sf_dir, "polls"), ["node_id"], ["poll_ms", "seq"], RANGES)
    return events.task_runs(events.poll_to_events(polls, cut=CUT), cut=CUT)


# --- D: counters and gauges


@registered("counters", "SELECT name, seq, CASE WHEN lag(total) OVER w IS NULL THEN total ELSE greatest(total - lag(total) OVER w, 0) END AS total, cnt FROM counters WINDOW w AS (PARTITION BY name ORDER BY seq)")
def d1_delta_first_absolute(spark, sf_dir):
    return counters.delta_first_absolute(view(spark, sf_dir, "counters"), ["name"], ["seq"], ["total"], ["cnt"])


#: Ranges that the hot keys of the given tables (a fifth of all events each) are cut into, of about 4 MB at the largest scale.
RANGES = 32


@registered("counters", "SELECT name, seq, CASE WHEN lag(total) OVER w IS NULL THEN total ELSE greatest(total - lag(total) OVER w, 0) END AS total, cnt FROM counters WINDOW w AS (PARTITION BY name ORDER BY seq)")
def d1_delta_hot_keys(spark, sf_dir):
    """The same with keys cut into ranges."""
    return counters.delta_first_absolute(view(spark, sf_dir, "counters"), ["name"], ["seq"], ["total"], ["cnt"], ranges=RANGES)


@registered("polls", f"{POLLED} SELECT * FROM e")
def c7_poll_hot_nodes(spark, sf_dir):
    """Polls of nodes that are cut into ranges, with runs counted across them."""
    return events.poll_to_events(view(spark, sf_dir, "polls"), ranges=RANGES)


@registered("counters", f"SELECT name, seq, CASE WHEN ms - lag(ms) OVER w <= {HOUR} THEN greatest(total - lag(total) OVER w, 0) ELSE 0 END AS delta FROM counters WINDOW w AS (PARTITION BY name ORDER BY ms, seq)")
def d2_delta_max_gap(spark, sf_dir):
    return counters.delta_max_gap(view(spark, sf_dir, "counters"), ["name"], "ms", "total", HOUR, ["seq"]).select("name", "seq", "delta")


MEAN = "SELECT name, seq, CASE WHEN dc {op} 0 THEN 0.0 ELSE dt / nullif(dc, 0) END AS mean FROM (SELECT name, seq, total - lag(total, 1, 0) OVER w AS dt, cnt % 7 - lag(cnt % 7, 1, 0) OVER w AS dc FROM counters WINDOW w AS (PARTITION BY name ORDER BY seq))"


@registered("counters", MEAN.format(op="<="))
def d3_interval_mean(spark, sf_dir):
    return counters.interval_mean(view(spark, sf_dir, "counters").withColumn("cnt", F.col("cnt") % 7), ["name"], ["seq"], "total", "cnt").select("name", "seq", "mean")


@registered("counters", MEAN.format(op="="))
def d3_interval_mean_keep(spark, sf_dir):
    return counters.interval_mean(view(spark, sf_dir, "counters").withColumn("cnt", F.col("cnt") % 7), ["name"], ["seq"], "total", "cnt", "keep").select("name", "seq", "mean")


@registered("counters", "SELECT name, seq, greatest(total - lag(total, 1, 0) OVER w, 0) AS failures FROM counters WINDOW w AS (PARTITION BY name ORDER BY seq)")
def d4_interval_failures(spark, sf_dir):
    return counters.interval_failures(view(spark, sf_dir, "counters"), ["name"], ["seq"], "total").select("name", "seq", "failures")


@registered("counters", "SELECT name, seq, total - lag(total, 1, 0) OVER w AS failures FROM counters WINDOW w AS (PARTITION BY name ORDER BY seq)")
def d4_interval_failures_signed(spark, sf_dir):
    return counters.interval_failures(view(spark, sf_dir, "counters"), ["name"], ["seq"], "total", clamp=False).select("name", "seq", "failures")


@registered("ip_counters", """, d AS (
    SELECT node_id, ms, seq, ms - lag(ms) OVER w AS t, in_packets - lag(in_packets) OVER w AS ip, in_delivers - lag(in_delivers) OVER w AS id, in_bytes - lag(in_bytes) OVER w AS ib,
        out_packets - lag(out_packets) OVER w AS op, out_discards - lag(out_discards) OVER w + out_no_routes - lag(out_no_routes) OVER w AS od, out_bytes - lag(out_bytes) OVER w AS ob
    FROM ip_counters WINDOW w AS (PARTITION BY node_id ORDER BY ms, seq))
    SELECT node_id, ms, seq, 'in' AS direction, 1000 * ip / nullif(t, 0) AS packets, 1000 * (ip - id) / nullif(t, 0) AS drops, 8000 * ib / nullif(t, 0) AS bits FROM d WHERE t IS NOT NULL
    UNION ALL SELECT node_id, ms, seq, 'out', 1000 * op / nullif(t, 0), 1000 * od / nullif(t, 0), 8000 * ob / nullif(t, 0) FROM d WHERE t IS NOT NULL""")
def d5_counter_rate(spark, sf_dir):
    return counters.counter_rate(view(spark, sf_dir, "ip_counters"), ["node_id"], "ms", ["seq"])


@registered("tcp_flows", "SELECT dest, count(*) AS flows, sum(tx_queue) / count(*) AS tx_queue, sum(rx_queue) / count(*) AS rx_queue, sum(lost) / count(*) AS lost, sum(send_cwnd) / count(*) AS send_cwnd, sum(ssthresh) / count(*) AS ssthresh FROM tcp_flows GROUP BY dest")
def d6_flow_means(spark, sf_dir):
    return counters.flow_means(view(spark, sf_dir, "tcp_flows"))


@registered("counters", f"SELECT seq, name, ms, total, cnt, ms - ms % {HOUR} AS bucket FROM counters QUALIFY row_number() OVER (PARTITION BY name, ms - ms % {HOUR} ORDER BY ms DESC, seq DESC) = 1")
def d7_last_sample(spark, sf_dir):
    return counters.last_sample(view(spark, sf_dir, "counters"), ["name"], "ms", HOUR, ["seq"])


# --- E: joins and correlation

ALIGNED = """, {first}h AS (SELECT node_id, thread_id, cpu, sample_ms AS t1, lag(sample_ms) OVER (PARTITION BY node_id, thread_id ORDER BY sample_ms, seq) AS t0 FROM {source}),
    x AS (SELECT *, unnest(generate_series(t0 - t0 % 3600000, t1 - 1 - (t1 - 1) % 3600000, 3600000)) AS bucket FROM h WHERE t0 < t1),
    a AS (SELECT node_id, thread_id, bucket, sum((least(t1, bucket + 3600000) - greatest(t0, bucket)) * cpu) / sum(least(t1, bucket + 3600000) - greatest(t0, bucket)) AS cpu FROM x GROUP BY ALL)"""
WEIGHTED = ALIGNED.format(first="", source="thread_samples")
LAST = "l AS (SELECT * FROM thread_samples QUALIFY row_number() OVER (PARTITION BY node_id, thread_id, sample_ms - sample_ms % 3600000 ORDER BY sample_ms DESC, seq DESC) = 1), "


def _aligned(spark, sf_dir, mode="weighted"):
    return correlate.align(view(spark, sf_dir, "thread_samples"), ["node_id", "thread_id"], "sample_ms", "cpu", HOUR, mode, ["seq"])


@registered("thread_samples", f"{WEIGHTED} SELECT node_id, thread_id, bucket, round(cpu, 6) AS cpu FROM a")
def e1_align(spark, sf_dir):
    return _aligned(spark, sf_dir).withColumn("cpu", F.round("cpu", 6))


@registered("thread_samples", f"{ALIGNED.format(first=LAST, source='l')} SELECT node_id, thread_id, bucket, round(cpu, 6) AS cpu FROM a")
def e1_align_latest(spark, sf_dir):
    return _aligned(spark, sf_dir, "latest").withColumn("cpu", F.round("cpu", 6))


@registered("thread_samples", WEIGHTED + """,
    q AS (SELECT *, t0 - t0 % 3600000 AS f, (t1 - 1) - (t1 - 1) % 3600000 AS l FROM h WHERE t0 < t1),
    r AS (SELECT node_id, thread_id, cpu, CASE WHEN f = t0 THEN f ELSE f + 3600000 END AS from_ms, CASE WHEN l + 3600000 = t1 THEN t1 ELSE l END AS to_ms FROM q),
    o AS (SELECT *, least(t1, bucket + 3600000) - greatest(t0, bucket) AS w FROM x)
    SELECT node_id, thread_id, from_ms, to_ms, round(cpu, 6) AS cpu FROM r WHERE from_ms < to_ms
    UNION ALL SELECT node_id, thread_id, bucket, bucket + 3600000, round(sum(w * cpu) / sum(w), 6) FROM o WHERE w < 3600000 GROUP BY ALL""")
def e1_align_runs(spark, sf_dir):
    """Aligned values with whole buckets of one sample as one row."""
    found = correlate.align_runs(view(spark, sf_dir, "thread_samples"), ["node_id", "thread_id"], "sample_ms", "cpu", HOUR, tiebreak=["seq"])
    return found.withColumn("cpu", F.round("cpu", 6))


@registered("thread_samples op_start op_finish", WEIGHTED + PAIRED + """,
    o AS (SELECT *, unnest(generate_series(start_ms - start_ms % 3600000, finish_ms - 1 - (finish_ms - 1) % 3600000, 3600000)) AS bucket FROM pair WHERE start_ms < finish_ms),
    b AS (SELECT node_id, thread_id, bucket, op, index_name, shard_id, sum(least(finish_ms, bucket + 3600000) - greatest(start_ms, bucket)) AS busy FROM o GROUP BY ALL),
    t AS (SELECT node_id, thread_id, bucket, sum(busy) AS busy FROM b GROUP BY ALL),
    r AS (SELECT bucket, node_id, op, index_name, shard_id, cpu * busy / 3600000 AS cpu FROM a JOIN b USING (node_id, thread_id, bucket)
          UNION ALL SELECT bucket, node_id, 'other', NULL, NULL, cpu * (1 - least(coalesce(busy, 0) / 3600000, 1)) FROM a LEFT JOIN t USING (node_id, thread_id, bucket))
    SELECT bucket, node_id, op, index_name, shard_id, round(sum(cpu), 6) AS cpu FROM r GROUP BY ALL""")
def e2_attribute_resources(spark, sf_dir):
    found = correlate.attribute_resources(_aligned(spark, sf_dir), c1_pair_events(spark, sf_dir), "cpu", HOUR)
    return found.withColumn("cpu", F.round("cpu", 6))


OVERRIDES = """, m AS (SELECT cluster_id, kind, component, arg_max(enabled, (ts, seq)) AS enabled FROM overrides WHERE NOT two_sided GROUP BY ALL)"""


def _overrides(spark, sf_dir, name="overrides"):
    rows = view(spark, sf_dir, name)
    side = lambda on: F.struct(*[F.when((F.col("kind") == i) & (F.col("two_sided") | (F.col("enabled") == on)), F.array("component")).alias(k) for i, k in enumerate(config.KINDS)])
    return rows.select("cluster_id", "ts", "seq", side(True).alias("enable"), side(False).alias("disable"))


@registered("overrides", OVERRIDES + " SELECT e.event_id, e.collector FROM (SELECT *, 'x' || (k % 10) AS collector FROM ev) e WHERE collector IN (SELECT component FROM m WHERE kind = 3 AND enabled)")
def e3_gate_by_collector(spark, sf_dir):
    on = config.fold_overrides(_overrides(spark, sf_dir)).filter("kind = 'collectors'").select(F.explode("enabled").alias("collector"))
    return correlate.gate_by_collector(view(spark, sf_dir, "ev").select("event_id", F.concat(F.lit("x"), F.col("k") % 10).alias("collector")), on)


INTERVALS = """, s AS (SELECT cluster_id, component, ts, arg_max(enabled, seq) AS enabled FROM switches WHERE NOT two_sided AND kind = 3 GROUP BY ALL),
    b AS (SELECT *, coalesce(lag(enabled) OVER (PARTITION BY cluster_id, component ORDER BY ts), false) AS was FROM s),
    i AS (SELECT *, lead(ts) OVER (PARTITION BY cluster_id, component ORDER BY ts) AS to_ms FROM b WHERE enabled <> was)"""


@registered("switches", f"{INTERVALS} SELECT cluster_id, 'collectors' AS kind, component AS name, ts AS from_ms, to_ms FROM i WHERE enabled")
def h1_override_intervals(spark, sf_dir):
    return config.override_intervals(_overrides(spark, sf_dir, "switches")).filter("kind = 'collectors'")


@registered("switches", f"{INTERVALS} SELECT e.event_id, e.cluster_id, e.collector, e.ms FROM (SELECT event_id, 'c' || (user_id % 3) AS cluster_id, 'x' || (k % 7) AS collector, ms FROM ev) e WHERE EXISTS (FROM i WHERE i.cluster_id = e.cluster_id AND i.component = e.collector AND enabled AND e.ms >= i.ts AND e.ms < coalesce(i.to_ms, 9e15))")
def e3_gate_as_of(spark, sf_dir):
    """Samples whose collector was enabled in their cluster when they were taken."""
    samples = view(spark, sf_dir, "ev").select("event_id", F.concat(F.lit("c"), F.col("user_id") % 3).alias("cluster_id"), F.concat(F.lit("x"), F.col("k") % 7).alias("collector"), "ms")
    return correlate.gate_as_of(samples, config.override_intervals(_overrides(spark, sf_dir, "switches")), "ms")


FOLDED = """, f AS (
    SELECT cluster_id, ts AS from_ms, lead(ts) OVER (PARTITION BY cluster_id ORDER BY ts, seq) AS to_ms, state & 1 AS p,
        last_value(CASE WHEN (state & 2) = 2 AND (state & 1) = 0 THEN NULL ELSE (state >> 1) & 1 END IGNORE NULLS) OVER w AS r,
        last_value(CASE WHEN (state & 4) = 4 AND (state & 1) = 0 THEN NULL ELSE (state >> 2) & 1 END IGNORE NULLS) OVER w AS l,
        last_value(CASE WHEN (state & 8) = 8 AND (state & 1) = 0 THEN NULL ELSE (state >> 3) & 1 END IGNORE NULLS) OVER w AS b
    FROM state_history WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
    i AS (SELECT cluster_id, from_ms, to_ms, unnest(['pipeline', 'rca', 'logging', 'batch']) AS feature, unnest([p = 1, coalesce(r, 0) = 1, coalesce(l, 0) = 1, coalesce(b, 0) = 1]) AS enabled FROM f)"""


@registered("state_history cluster_events", f"{FOLDED} SELECT e.* FROM cluster_events e WHERE EXISTS (FROM i WHERE feature = 'rca' AND enabled AND i.cluster_id = e.cluster_id AND e.ms >= from_ms AND e.ms < coalesce(to_ms, 9e15))")
def e4_gate_by_state(spark, sf_dir):
    intervals = config.fold_feature_state(view(spark, sf_dir, "state_history"))
    return correlate.gate_by_state(view(spark, sf_dir, "cluster_events"), intervals, "ms", feature="rca")


@registered("metrics units", "SELECT m.*, unit FROM metrics m LEFT JOIN units u ON m.metric = u.metric")
def e5_with_units(spark, sf_dir):
    return correlate.with_units(view(spark, sf_dir, "metrics"), view(spark, sf_dir, "units"))


# --- F: queries of the store


@registered("metrics", 'SELECT shard_id, round(avg(value) FILTER (metric = \'click\'), 6) AS click, round(sum(value) FILTER (metric = \'error\'), 6) AS error FROM metrics WHERE metric IN (\'click\', \'error\') GROUP BY shard_id')
def f1_query_metrics(spark, sf_dir):
    found = query.query_metrics(view(spark, sf_dir, "metrics"), ["click", "error"], ["avg", "sum"], ["shard_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("click", "error")})


@registered("metrics", "SELECT max(value) FILTER (metric = 'click') AS click, min(value) FILTER (metric = 'view') AS view FROM metrics")
def f1_query_metrics_total(spark, sf_dir):
    return query.query_metrics(view(spark, sf_dir, "metrics"), ["click", "view"], ["max", "min"], [""])


@registered("metrics", "SELECT m.* FROM metrics m WHERE bucket = (SELECT max(bucket) FROM metrics x WHERE x.node_id = m.node_id)")
def f2_latest(spark, sf_dir):
    return query.latest(view(spark, sf_dir, "metrics"))


@registered("metrics", f", c AS (SELECT * FROM metrics WHERE bucket + {HOUR} <= (SELECT max(ms) FROM ev)) SELECT c.* FROM c WHERE bucket = (SELECT max(bucket) FROM c x WHERE x.node_id = c.node_id)")
def f2_latest_complete(spark, sf_dir):
    now = view(spark, sf_dir, "ev").agg(F.max("ms")).first()[0]
    return query.latest(view(spark, sf_dir, "metrics"), now, HOUR)


@registered("metrics", "SELECT node_id, shard_id, max(value) AS click FROM metrics WHERE metric = 'click' GROUP BY ALL")
def f3_query_nodes(spark, sf_dir):
    return query.query_nodes(view(spark, sf_dir, "metrics"), ["click"], ["max"], ["shard_id"], nodes="all")


@registered("metrics", "SELECT node_id, max(value) AS click FROM metrics WHERE metric = 'click' AND node_id = 'n1' GROUP BY ALL")
def f3_query_local_node(spark, sf_dir):
    return query.query_nodes(view(spark, sf_dir, "metrics"), ["click"], ["max"], nodes="local", local_id="n1")


@registered("metrics", f"SELECT * FROM metrics WHERE metric IN ('click', 'view') AND bucket >= {RANGE[0]} AND bucket < {RANGE[1]} QUALIFY bucket = min(bucket) OVER (PARTITION BY node_id, metric, (bucket - {RANGE[0]}) // {DAY})")
def f4_query_batch(spark, sf_dir):
    return query.sampled(view(spark, sf_dir, "metrics"), ["click", "view"], *RANGE, DAY)


#: A store of 5-second buckets, as the batch query's rules ask for.
FINE = "fine AS (SELECT ms - ms % 5000 AS bucket, 'n' || (user_id % 3) AS node_id, event_type AS metric, value FROM ev), n AS (SELECT max(ms) AS now FROM ev)"


@registered("", f", {FINE} SELECT fine.* FROM fine, n WHERE metric IN ('click', 'view') AND bucket >= (now - 3480000) // 300000 * 300000 AND bucket < now // 300000 * 300000 QUALIFY bucket = min(bucket) OVER (PARTITION BY node_id, metric, bucket // 300000)")
def f4_query_batch_range(spark, sf_dir):
    """The last 58 minutes by parts of 5, under the rules of the batch query, its cap included."""
    ev = view(spark, sf_dir, "ev")
    now = ev.agg(F.max("ms")).first()[0]
    fine = ev.select(fn.bucket(F.col("ms"), 5000).alias("bucket"), F.concat(F.lit("n"), F.col("user_id") % 3).alias("node_id"), F.col("event_type").alias("metric"), "value")
    return query.query_batch(fine, ["click", "view"], now - 3_480_000, now, 300, now, 60)


@registered("metrics", "SELECT node_id, metric, count(*) AS n FROM metrics GROUP BY ALL")
def f5_cap_points(spark, sf_dir):
    return query.cap_points(view(spark, sf_dir, "metrics").groupBy("node_id", "metric").agg(F.count(F.lit(1)).alias("n")))


@registered("pending", "SELECT split_part(source, ' ', 1) AS task_type, count(*) AS n FROM pending GROUP BY ALL")
def f6_pending_tasks(spark, sf_dir):
    return query.pending_tasks(view(spark, sf_dir, "pending"))


@registered("error_log", "SELECT CASE WHEN grouping(code) = 1 THEN 'TOTAL' ELSE code END AS code, count(*) AS n FROM (SELECT coalesce(code, 'OTHER') AS code FROM error_log) GROUP BY ROLLUP (code)")
def f7_error_counts(spark, sf_dir):
    return query.error_counts(view(spark, sf_dir, "error_log"))


@registered("stage_log", "SELECT collector, stat, count(value) AS n, sum(value)::BIGINT AS sum, avg(value) AS avg, min(value) AS min, max(value) AS max FROM stage_log GROUP BY ALL")
def f8_stage_stats(spark, sf_dir):
    return query.stage_stats(view(spark, sf_dir, "stage_log"))


# --- G, H: sampling and configuration


@registered("node_keys", ", r AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY key) - 1) // 2 AS slot, ceil(count(*) OVER (PARTITION BY node) / 2)::BIGINT AS slots FROM node_keys) SELECT node, key, tick FROM r, (SELECT unnest(range(0, 40)) AS tick) WHERE tick % slots = slot")
def g1_rotating_sample(spark, sf_dir):
    return sampling.rotating_sample(view(spark, sf_dir, "node_keys"), ["node"], ["key"], ticks=40, n=2)


@registered("trackers", "SELECT * FROM trackers QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY bytes DESC, shard_id) <= 50")
def g2_hot_shards(spark, sf_dir):
    return sampling.hot_shards(view(spark, sf_dir, "trackers"), ["snapshot"], "bytes", ["shard_id"])


@registered("overrides", OVERRIDES + " SELECT cluster_id, ['rcas', 'deciders', 'actions', 'collectors'][kind + 1] AS kind, coalesce(string_agg(component, ',' ORDER BY component) FILTER (enabled), '') AS enabled, coalesce(string_agg(component, ',' ORDER BY component) FILTER (NOT enabled), '') AS disabled FROM m GROUP BY ALL")
def h1_fold_overrides(spark, sf_dir):
    return config.fold_overrides(_overrides(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("enabled", "disabled")})


@registered("state_history", f"{FOLDED} SELECT * FROM i")
def h2_fold_feature_state(spark, sf_dir):
    return config.fold_feature_state(view(spark, sf_dir, "state_history"))


# --- A: records, contracts, the store


def _rows(spark, sf_dir):
    """Sample records as text: a header and two objects on one line, every third of them broken."""
    ev = view(spark, sf_dir, "ev")
    header = F.concat(F.lit('{"current_time":'), F.col("ms"), F.lit("}"))
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("k").alias("estimated"), F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("tripped")))
    broken = F.when(F.col("event_id") % 3 == 0, F.lit('{"type": 5 oops}')).otherwise(F.lit('{"type":"x","limit":7}'))
    return ev.select(F.col("event_id").alias("record"), F.concat(header, F.lit("\n"), body, broken).alias("text"))


@registered("", "SELECT event_id AS record, 1 AS pos, ms AS time_ms, event_type AS type, k AS estimated, CASE WHEN k % 2 = 0 THEN user_id END AS tripped, NULL::BIGINT AS \"limit\" FROM ev UNION ALL SELECT event_id, 2, ms, 'x', NULL, NULL, 7 FROM ev WHERE event_id % 3 <> 0")
def a2_sample_records(spark, sf_dir):
    return logs.quarantine(logs.parsed(logs.sample_rows(_rows(spark, sf_dir), "record", "text"), FAMILIES["circuit_breaker"]))[0]


@registered("", "SELECT ms AS time_ms, event_type AS type, k AS estimated, CASE WHEN k % 2 = 0 THEN user_id END AS tripped, NULL::BIGINT AS \"limit\" FROM ev WHERE ms >= 1705000000000 UNION ALL SELECT ms, 'x', NULL, NULL, 7 FROM ev WHERE event_id % 3 <> 0 AND ms >= 1705000000000")
def a2_read_samples(spark, sf_dir):
    """The same records written to files of many headers each, and read by parts, from a time on."""
    path = new_path(spark, "samples")
    _rows(spark, sf_dir).select("text").write.text(path)
    found = logs.quarantine(logs.read_samples(spark, path, "circuit_breaker", between=(1_705_000_000_000, None)))[0]
    return found.drop("record", "pos")


@registered("", "SELECT count(*) AS bad FROM ev WHERE event_id % 3 = 0")
def a5_quarantine(spark, sf_dir):
    bad = logs.quarantine(logs.parsed(logs.sample_rows(_rows(spark, sf_dir), "record", "text"), FAMILIES["circuit_breaker"]))[1]
    return bad.agg(F.count(F.lit(1)).alias("bad"))


def _paths(spark, sf_dir):
    """Paths of which every fifth has too few keys and every seventh a key of another type."""
    ev = view(spark, sf_dir, "ev")
    thread = F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string"))
    whole = F.array(thread, F.col("event_type"), F.col("event_id").cast("string"), F.lit("start"))
    return ev.select("event_id", F.when(F.col("event_id") % 5 == 0, F.slice(whole, 1, 2)).otherwise(whole).alias("path"))


@registered("", "SELECT unnest(['good', 'bad', 'bad.arity', 'bad.type']) AS outcome, unnest([count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0), count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0), count(*) FILTER (event_id % 5 = 0), count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 = 0)]) AS n FROM ev")
def a5_write_good(spark, sf_dir):
    """Good rows written, and the bad ones counted by reason in the same pass."""
    found = logs.split_family(_paths(spark, sf_dir), "shard_search", {"thread_id": "bigint"})
    path = new_path(spark, "good")
    counts = logs.write_good(found, lambda good: good.write.parquet(path), logs.path_reasons("shard_search"))
    return spark.createDataFrame([*counts.items()], "outcome string, n long")


@registered("", "SELECT event_id, min(CASE WHEN event_id % 10 = 0 THEN user_id END) OVER (PARTITION BY user_id % 3, g) AS owner FROM (SELECT *, count(CASE WHEN event_id % 10 = 0 THEN 1 END) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS g FROM ev) QUALIFY event_id % 10 <> 0")
def a3_carry_headers(spark, sf_dir):
    rows = view(spark, sf_dir, "ev").select("event_id", (F.col("user_id") % 3).alias("part"), F.when(F.col("event_id") % 10 == 0, F.col("user_id")).alias("owner"))
    return logs.carry_headers(rows, ["event_id"], "owner", ["part"]).select("event_id", "owner")


@registered("", "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS good, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN user_id END AS thread_id, CASE WHEN event_id % 5 <> 0 THEN 'start' END AS edge FROM ev")
def a4_split_family(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    found = logs.split_family(paths, "shard_search", {"thread_id": "bigint"})
    return found.select("event_id", F.col("_corrupt").isNull().alias("good"), "thread_id", "edge")


@registered("metrics", f"SELECT * FROM metrics WHERE bucket >= {RANGE[0]} + 5 * {DAY} AND bucket < {RANGE[0]} + 9 * {DAY}")
def a6_a7_write_read_metrics(spark, sf_dir):
    path = new_path(spark, "store")
    store.write_metrics(view(spark, sf_dir, "metrics"), path)
    return store.read_metrics(spark, path, RANGE[0] + 5 * DAY, RANGE[0] + 9 * DAY).select("bucket", "node_id", "metric", "shard_id", "value")


@registered("metrics", f"SELECT * FROM metrics WHERE bucket >= {RANGE[0]} + {DAY} - 3600000 AND bucket <> -1")
def a8_retain(spark, sf_dir):
    return store.retain(view(spark, sf_dir, "metrics"), RANGE[0] + DAY, 60)


@registered("metrics", f"SELECT * FROM metrics WHERE bucket >= {RANGE[0]} + 10 * {DAY} + 600000 - 3600000")
def a8_retain_store(spark, sf_dir):
    """The table in a store whose retention then drops whole days and rewrites the day of the cut."""
    path = new_path(spark, "store")
    store.write_metrics(view(spark, sf_dir, "metrics"), path)
    store.retain_store(spark, path, RANGE[0] + 10 * DAY + 600_000, 60, grace_ms=0)
    return store.read_metrics(spark, path).select("bucket", "node_id", "metric", "shard_id", "value")


@registered("metrics", f"""SELECT node_id, to_json({{'data': {{'fields': [{{'name': 'shard_id', 'type': 'DOUBLE'}}, {{'name': 'click', 'type': 'DOUBLE'}}],
    'records': list([CAST(shard_id::DOUBLE AS STRING), CAST(click AS STRING)] ORDER BY shard_id)}}, 'timestamp': {RANGE[1]}}})::STRING AS response
    FROM (SELECT node_id, shard_id, max(value) AS click FROM metrics WHERE metric = 'click' GROUP BY ALL) GROUP BY node_id""")
def a9_to_response(spark, sf_dir):
    found = f3_query_nodes(spark, sf_dir).withColumn("bucket", F.lit(RANGE[1]))
    return store.to_response(found, ["shard_id", "click"])


@registered("", "SELECT 'limit' AS key, 'missing' AS kind, count(*) AS n FROM ev UNION ALL SELECT 'tripped', 'missing', count(*) FROM ev WHERE k % 2 <> 0 UNION ALL SELECT 'extra', 'unknown', count(*) FROM ev")
def a10_check_contract(spark, sf_dir):
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("k").alias("estimated"), F.when(F.col("k") % 2 == 0, F.col("user_id")).alias("tripped"), F.lit(1).alias("extra")))
    return logs.check_contract(view(spark, sf_dir, "ev").select(body.alias("json")), ["type"], ["estimated", "tripped", "limit"])


@registered("op_start op_finish", f"{PAIRED} SELECT node_id, op, index_name, shard_id, {LATENCY}, sum(failed::INT)::BIGINT AS failures FROM pair GROUP BY ALL")
def a1_log_to_metrics(spark, sf_dir):
    """Events written as a log, read back, split, set aside if broken, paired and aggregated."""
    entry = lambda *names: F.concat_ws("\n", *[F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in names])
    keys = F.concat_ws("/", "thread_id", "op", "op_id")
    starts = view(spark, sf_dir, "op_start").select(F.concat(keys, F.lit("/start\n"), entry("node_id", "start_ms", "items", "index_name", "shard_id")).alias("value"))
    finishes = view(spark, sf_dir, "op_finish").select(F.concat(keys, F.lit("/finish\n"), entry("node_id", "finish_ms", "failed")).alias("value"))
    broken = starts.limit(10).select(F.lit("1/start\nnode_id:x").alias("value"))
    path = new_path(spark, "log")
    starts.union(finishes).union(broken).write.option("lineSep", "$^").text(path)
    good, _ = logs.quarantine(logs.split_family(logs.read_events(spark, path), "shard_search", {"thread_id": "bigint", "id": "bigint"}))
    typed = lambda edge, **kinds: good.filter(F.col("edge") == edge).select("thread_id", F.col("phase").alias("op"), F.col("id").alias("op_id"), *[F.col("kv")[k].cast(t).alias(k) for k, t in kinds.items()])
    found = events.pair_events(
        typed("start", node_id="string", start_ms="bigint", items="bigint", index_name="string", shard_id="bigint"), typed("finish", node_id="string", finish_ms="bigint", failed="boolean")
    )
    return found.groupBy("node_id", "op", "index_name", "shard_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("items").alias("items"), F.sum("latency_ms").alias("latency_sum"), F.avg("latency_ms").alias("latency_avg"),
        F.min("latency_ms").alias("latency_min"), F.max("latency_ms").alias("latency_max"), F.sum(F.col("failed").cast("int")).alias("failures"),
    )


# --- I: streams, run over what there is


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with the columns of the view ev and ts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({"ms": F.unix_millis("ts"), "k": F.get_json_object("props", "$.k").cast("long")})


def _operations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Starts and finishes of the views op_start and op_finish as streams."""
    ev = _stream(spark, sf_dir)
    keys = {"op_id": F.col("event_id"), "node_id": F.concat(F.lit("n"), F.col("user_id") % 3), "thread_id": F.col("user_id") % 16, "op": F.col("event_type")}
    starts = ev.filter("event_id % 11 <> 5").select(*[c.alias(k) for k, c in keys.items()], F.timestamp_millis("ms").alias("start_ts"))
    finishes = ev.filter("event_id % 10 <> 3").select(*[c.alias(k) for k, c in keys.items()], F.timestamp_millis(F.col("ms") + F.floor(F.col("value") * 1000)).alias("finish_ts"))
    return starts, finishes


def _ran(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return streaming.run_available(stream, new_path(spark, "stream"), new_path(spark, "progress"))


@registered("", f", p AS (SELECT *, ms - ms % {HOUR} AS b, {RANGE[0]} + 100 * {HOUR} AS purge FROM ev) SELECT CASE WHEN b = purge - {HOUR} THEN 'current' WHEN b = purge THEN 'next' ELSE 'stale' END AS route, count(*) AS n FROM p GROUP BY ALL")
def i1_route_buckets(spark, sf_dir):
    routed = streaming.route_buckets(view(spark, sf_dir, "ev"), RANGE[0] + 100 * HOUR + 1234, HOUR)
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@registered("op_start op_finish", f"{PAIRED} SELECT op_id, latency_ms FROM pair WHERE latency_ms <= 600000")
def i2_stream_pair_events(spark, sf_dir):
    found = streaming.stream_pair_events(*_operations(spark, sf_dir))
    return _ran(found).filter("finish_ts IS NOT NULL").select("op_id", "latency_ms")


# what is final by the streams' watermark, which is that of the one that is behind
FINAL = """, w AS (SELECT least((SELECT max(start_ms) FROM op_start), (SELECT max(finish_ms) FROM op_finish)) - 5000 AS mark),
    j AS (SELECT coalesce(s.op_id, f.op_id) AS op_id, s.start_ms, f.finish_ms, f.finish_ms - s.start_ms AS latency_ms FROM op_start s
        FULL OUTER JOIN op_finish f ON s.node_id = f.node_id AND s.thread_id = f.thread_id AND s.op = f.op AND s.op_id = f.op_id AND f.finish_ms >= s.start_ms AND f.finish_ms <= s.start_ms + 600000),
    c AS (SELECT op_id, CASE WHEN start_ms IS NULL THEN 'orphan_finish' WHEN finish_ms IS NULL THEN 'expired' ELSE 'complete' END AS state, latency_ms FROM j, w
        WHERE latency_ms IS NOT NULL OR (start_ms IS NULL AND finish_ms < mark) OR (finish_ms IS NULL AND start_ms + 600000 < mark))"""


@registered("op_start op_finish", f"{FINAL} SELECT * FROM c")
def i2_stream_classify_pairs(spark, sf_dir):
    """Operations that are complete, expired or without a start, as soon as that is final."""
    return _ran(streaming.stream_classify_pairs(*_operations(spark, sf_dir))).select("op_id", "state", "latency_ms")


@registered("", f"SELECT event_type AS name, ms, event_id AS seq, CASE WHEN ms - lag(ms) OVER w <= {HOUR} THEN greatest(k * 50 - lag(k * 50) OVER w, 0) ELSE 0 END AS delta FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ms, event_id)")
def i3_stream_counter_deltas(spark, sf_dir):
    samples = _stream(spark, sf_dir).select(F.col("event_type").alias("name"), "ms", F.col("event_id").alias("seq"), (F.col("k") * 50).alias("total"))
    return _ran(streaming.stream_counter_deltas(samples, ["name"], "ms", "seq", "total", "max_gap", HOUR))


@registered("polls", f"{POLLED} SELECT * EXCLUDE (age_ms) FROM e")
def i4_stream_poll_events(spark, sf_dir):
    ev = _stream(spark, sf_dir)
    polls = ev.select(
        F.concat(F.lit("n"), F.col("user_id") % 3).alias("node_id"), F.col("event_id").alias("seq"), F.col("ms").alias("poll_ms"),
        F.when(F.col("event_id") % 17 != 0, F.floor(F.col("event_id") / 3)).alias("head_order"), F.concat("event_type", F.lit(" ["), "k", F.lit("]")).alias("source"),
    )
    return _ran(streaming.stream_poll_events(polls))


@registered("op_start", "SELECT node_id, thread_id, op_id, start_ms, finish_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY node_id, thread_id ORDER BY start_ms, op_id) AS finish_ms FROM op_start) WHERE finish_ms IS NOT NULL")
def i4_stream_implicit_finish(spark, sf_dir):
    ev = _stream(spark, sf_dir).filter("event_id % 11 <> 5")
    return _ran(streaming.stream_implicit_finish(ev.select(F.concat(F.lit("n"), F.col("user_id") % 3).alias("node_id"), (F.col("user_id") % 16).alias("thread_id"), F.col("event_id").alias("op_id"), F.col("ms").alias("start_ms"))))


@registered("", f"SELECT ms - ms % {HOUR} AS bucket, event_type, count(*) AS n, sum(k)::BIGINT AS sum, min(k) AS min, max(k) AS max FROM ev WHERE ms - ms % {HOUR} + {HOUR} <= (SELECT max(ms) FROM ev) - 5000 GROUP BY ALL")
def i5_stream_metrics(spark, sf_dir):
    return _ran(streaming.stream_metrics(_stream(spark, sf_dir), ["event_type"], "k", "1 hour"))


@registered("", f"SELECT ms - ms % {HOUR} AS bucket, event_type, 'k_sum' AS metric, sum(k)::DOUBLE AS value FROM ev WHERE ms - ms % {HOUR} + {HOUR} <= (SELECT max(ms) FROM ev) - 5000 GROUP BY ALL")
def i5_stream_into_store(spark, sf_dir):
    """Final buckets of a stream, written into a metric store batch by batch, and read back."""
    final = streaming.stream_metrics(_stream(spark, sf_dir), ["event_type"], "k", "1 hour")
    rows = final.select("bucket", "event_type", F.lit("k_sum").alias("metric"), F.col("sum").cast("double").alias("value"))
    path = new_path(spark, "store")
    store.stream_into_store(rows, path, new_path(spark, "progress"), "hours").awaitTermination()
    return store.read_metrics(spark, path)


@registered("op_start op_finish", f"{PAIRED}, g AS (SELECT finish_ms - finish_ms % {HOUR} AS bucket, op, index_name, shard_id, avg(latency_ms) AS l, sum(items) AS i FROM pair GROUP BY ALL) SELECT index_name, shard_id, round(avg(l), 6) AS latency_avg, sum(i)::DOUBLE AS items FROM g GROUP BY ALL")
def query_latency_by_shard(spark, sf_dir):
    return flagship(spark, sf_dir).withColumn("latency_avg", F.round("latency_avg", 6))
