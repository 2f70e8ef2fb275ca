"""The metric store: Parquet by metric, date and write; streams into it, retention on disk, and responses as JSON.

Below `metric=.../bucket_date=.../write=...` each write has folders of its own. What readers see is decided by small files
in `_store`, each of which is replaced at once and has one writer:

* `schema.json`: the columns, so that nothing is guessed from data or folder names;
* `stream-<name>.json`: the last micro-batch of a stream that is whole;
* `cut.json`: since when rows are kept, and when that was decided;
* `edge.json`: writes whose rows of the cut's own day stand in a rewritten one.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from .shared import File

PARTITIONS = ("metric", "bucket_date", "write")
DAY_MS = 86_400_000


def _date(ms: Column) -> Column:
    """Days of UTC, whatever the session's time zone is."""
    return F.date_from_unix_date(((ms - F.pmod(ms, F.lit(DAY_MS))) / DAY_MS).cast("int"))


def _day(ms: int) -> str:
    return (datetime.date(1970, 1, 1) + datetime.timedelta(days=ms // DAY_MS)).isoformat()


def _file(spark: SparkSession, path: str, name: str) -> File:
    return File(spark, f"{path}/_store/{name}.json")


def store_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Columns of a store, its partitions last; None where nothing was ever written."""
    found = _file(spark, path, "schema").read()
    return None if found is None else T.StructType.fromJson(json.loads(found))


def declare(spark: SparkSession, path: str, columns: T.StructType) -> T.StructType:
    """A store's schema with these columns added. A column may come later, and is null in older rows; its type stays."""
    old = store_schema(spark, path)
    fields = {f.name: f for f in old if f.name not in PARTITIONS} if old else {}
    for f in columns:
        if f.name in PARTITIONS:
            continue
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    if "bucket" not in fields:
        raise ValueError("metrics need a bucket, in milliseconds")
    kinds = {"metric": T.StringType(), "bucket_date": T.DateType(), "write": T.StringType()}
    new = T.StructType([*fields.values(), *[T.StructField(p, kinds[p]) for p in PARTITIONS]])
    if old != new:
        _file(spark, path, "schema").replace(new.json())
    return new


def _write(df: DataFrame, path: str, write: str, mode: str) -> None:
    """Small parts of a metric's day are written together, large ones by several tasks."""
    out = df.withColumns({"metric": F.col("metric").cast("string"), "bucket_date": _date(F.col("bucket")), "write": F.lit(write)})
    writer = out.hint("rebalance", "metric", "bucket_date").write.partitionBy(*PARTITIONS)
    (writer.mode("append") if mode == "append" else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")).parquet(path)


def write_metrics(df: DataFrame, path: str, replace: bool = False, now: int | None = None, interval_ms: int = 5000) -> DataFrame:
    """Appends metrics; what a job writes is visible when the job has committed. replace: the metrics' days take the place of those there.

    With now (milliseconds), buckets whose time isn't over by then are held back; returned are
    the rows held back. Nothing to write makes an empty store, no error. A null metric is one of its own.
    """
    spark = df.sparkSession
    declare(spark, path, df.schema)
    over = F.lit(True) if now is None else F.col("bucket") + interval_ms <= now
    write = f"w-{uuid.uuid4().hex}"
    _write(df.filter(over), path, write, "append")
    if replace:
        root = File(spark, path)
        for metric in (m for m in root.children() if m.name.startswith("metric=")):
            for day in metric.children():
                writes = {w.name: w for w in day.children()}
                if f"write={write}" in writes:
                    for name in writes.keys() - {f"write={write}"}:
                        writes[name].delete()
    return df.filter(~over)


def write_batch(df: DataFrame, path: str, stream: str, batch: int) -> bool:
    """A micro-batch of a stream into the store, once: False if it is there already.

    Its folders are named after stream and batch, so that a batch that ended halfway is
    written over. Readers see it from the moment that the stream's file names it.
    """
    spark = df.sparkSession
    ledger = _file(spark, path, f"stream-{stream}")
    done = ledger.read()
    if done is not None and json.loads(done)["batch"] >= batch:
        df.write.format("noop").mode("overwrite").save()  # the stream's state is that of this batch only once its rows were made
        return False
    declare(spark, path, df.schema)
    _write(df, path, f"s-{stream}-{batch:012d}", "overwrite")
    ledger.replace(json.dumps({"batch": batch}))
    return True


def stream_into_store(stream: DataFrame, path: str, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Starts a stream of final metric rows (bucket, metric, ...) into the store. once: ends when all that there is was read."""
    if not name.replace("_", "").isalnum():
        raise ValueError("a stream's name is made of letters, digits and _")
    declare(stream.sparkSession, path, stream.schema)
    writer = stream.writeStream.outputMode("append").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_batch(df, path, name, batch) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _visible(spark: SparkSession, path: str, cut: bool = True) -> Column:
    """Rows that readers see, by their partitions first. cut False: also rows that retention has cut off."""
    shown = ~F.col("write").startswith("s-") & ~F.col("write").startswith("e-")
    for f in File(spark, f"{path}/_store").children():
        if f.name.startswith("stream-"):
            name = f.name.removeprefix("stream-").removesuffix(".json")
            last = json.loads(f.read())["batch"]
            shown |= F.col("write").startswith(f"s-{name}-") & (F.col("write") <= f"s-{name}-{last:012d}") & (F.length("write") == len(f"s-{name}-") + 12)
    edge = _file(spark, path, "edge").read()
    if edge is not None:
        edge = json.loads(edge)
        day = F.to_date(F.lit(edge["day"]))
        shown = F.when(F.col("bucket_date") != day, shown).otherwise((shown & ~F.col("write").isin(edge["hidden"])) | (F.col("write") == edge["write"]))
    since = _file(spark, path, "cut").read() if cut else None
    if since is not None:
        since = json.loads(since)["cut"]
        shown &= (F.col("bucket_date") >= _date(F.lit(since))) & (F.col("bucket") >= since)
    return shown


def _all(spark: SparkSession, path: str) -> DataFrame | None:
    schema = store_schema(spark, path)
    return None if schema is None else spark.read.schema(schema).option("basePath", path).parquet(path)


def read_metrics(spark: SparkSession, path: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """Archived metrics of [t0, t1), by their date's partitions first; whole writes that are within retention. Types are those that were written."""
    df = _all(spark, path)
    if df is None:
        raise ValueError(f"no metric store at {path}")
    df = df.filter(_visible(spark, path))
    if t0 is not None:
        df = df.filter((F.col("bucket_date") >= _date(F.lit(t0))) & (F.col("bucket") >= t0))
    if t1 is not None:
        df = df.filter((F.col("bucket_date") <= _date(F.lit(t1))) & (F.col("bucket") < t1))
    return df.drop("bucket_date", "write")


def _check_minutes(minutes: int) -> None:
    if not 1 <= minutes <= 60:
        raise ValueError("retention must be from 1 to 60 minutes")


def retain(df: DataFrame, now: int, minutes: int) -> DataFrame:
    """Rows of the last minutes, from 1 to 60."""
    _check_minutes(minutes)
    return df.filter(F.col("bucket") >= now - minutes * 60_000)


def retain_store(spark: SparkSession, path: str, now: int, minutes: int, grace_ms: int = 600_000) -> dict[str, int]:
    """Keeps the last minutes (1 to 60) of a store, on disk too. Meant to be called again and again, by one process. Returns what it did: days dropped, rows of the edge rewritten, writes dropped.

    1. The cut moves: readers who start from now on see rows since then alone.
    2. Days before a cut that is at least grace_ms old are dropped as folders, without being read. A
       reader who started before the cut moved has had that long.
    3. Of the cut's own day, writes with rows from before are rewritten without them, into a write that readers see from the
       moment that it takes the others' place. Those are dropped by a later call, as above.
    """
    _check_minutes(minutes)
    did = {"days": 0, "rewritten": 0, "writes": 0}
    cut_file, edge_file = _file(spark, path, "cut"), _file(spark, path, "edge")
    schema = store_schema(spark, path)
    if schema is None:
        return did
    before = json.loads(cut_file.read() or "null")
    cut = max(now - minutes * 60_000, before["cut"] if before else -(1 << 62))
    # of cuts that are still too young to drop by, the oldest counts
    old = [c for c in (before["history"] if before else []) if c["at"] > now - grace_ms]
    ripe = [c["cut"] for c in (before["history"] if before else []) if c["at"] <= now - grace_ms]
    dropped_to = max(ripe, default=before["dropped_to"] if before else None)
    history = [*old, {"cut": cut, "at": now}]
    if grace_ms == 0:
        dropped_to = cut
    cut_file.replace(json.dumps({"cut": cut, "history": history, "dropped_to": dropped_to}))
    days = [d for m in File(spark, path).children() if m.name.startswith("metric=") for d in m.children() if d.name.startswith("bucket_date=")]
    if dropped_to is not None:
        for d in days:
            day = d.name.removeprefix("bucket_date=")
            if day < _day(dropped_to) and not day.startswith("__"):
                d.delete()
                did["days"] += 1
        days = [d for d in days if d.exists()]

    edge, today = json.loads(edge_file.read() or "null"), _day(cut)
    if edge and edge["at"] > now - grace_ms:
        return did  # the writes that it hides may be in use still
    for w in (w for d in days if edge and d.name == f"bucket_date={edge['day']}" for w in d.children()):
        if w.name.removeprefix("write=") in edge["hidden"]:
            w.delete()
            did["writes"] += 1
    rows = _all(spark, path).filter((F.col("bucket_date") == F.to_date(F.lit(today))) & _visible(spark, path, cut=False))
    # at most one row for each write of a day
    outdated = [r["write"] for r in rows.groupBy("write").agg(F.min("bucket").alias("least")).filter(F.col("least") < cut).sort("write").collect()]
    if outdated:
        write = f"e-{cut}-{uuid.uuid4().hex[:8]}"
        keep = rows.filter(F.col("write").isin(outdated) & (F.col("bucket") >= cut))
        _write(keep.drop("bucket_date", "write"), path, write, "append")
        did["rewritten"] = _all(spark, path).filter(F.col("write") == write).count()
        edge_file.replace(json.dumps({"day": today, "write": write, "hidden": outdated, "at": now}))
    return did


def to_response(df: DataFrame, fields: Sequence[str], node: str = "node_id", time: str = "bucket", most: int = 100_800) -> DataFrame:
    """Per node its result as JSON: fields with VARCHAR or DOUBLE, records in their order, the node's latest time.

    A node with more than `most` records has several responses, all but one of them full. Its records are dealt into salts by
    their hash and numbered within, each salt on from the one before, so that no task sorts a node's records together.
    """
    kinds = {c: "VARCHAR" if t in ("string", "boolean") else "DOUBLE" for c, t in df.dtypes}
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("type")) for c in fields])
    record = F.array(*[F.col(c).cast("string") if kinds[c] == "VARCHAR" else F.col(c).cast("double").cast("string") for c in fields])
    held = df.select(F.col(node).alias("__node"), F.col(time).alias("__time"), record.alias("__record"))
    sizes = held.groupBy("__node").agg(F.count(F.lit(1)).alias("__n"), F.max("__time").alias("__latest")).withColumnRenamed("__node", "__own")
    salts = F.when(F.col("__n") <= most, F.lit(1)).otherwise(F.ceil(F.col("__n") * 2 / most))
    held = held.join(sizes, F.col("__node").eqNullSafe(F.col("__own"))).withColumn("__salt", F.pmod(F.xxhash64("__record"), salts)).drop("__own", "__n")
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1))
    counts = held.groupBy(F.col("__node").alias("__of"), F.col("__salt").alias("__from")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    held = held.join(counts, F.col("__node").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__from")))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__node", "__salt").orderBy("__record")) - 1
    rows = held.withColumn("__part", F.floor(number / most)).groupBy("__node", "__part")
    rows = rows.agg(F.sort_array(F.collect_list("__record")).alias("records"), F.first("__latest").alias("timestamp"))
    return rows.select(F.col("__node").alias(node), F.to_json(F.struct(F.struct(named.alias("fields"), F.col("records")).alias("data"), F.col("timestamp"))).alias("response"))


def rows_json(df: DataFrame) -> DataFrame:
    """Each row as JSON, without its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))
