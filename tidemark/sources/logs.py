"""Event logs and sample records as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import running
from ..schemas import FAMILIES, PATHS, Family


def read_events(spark: SparkSession, path: str, between: str = "$^") -> DataFrame:
    """Records `^path\\nkey:value...$` of an event log, scanned in parallel: file, path (keys), kv.

    Lines are split at their first colon. between: what parts two records, "$\\n^" where each stands on lines of its own.
    """
    raw = spark.read.option("lineSep", between).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    texts = raw.select("file", F.regexp_replace("value", r"\A\s*\^|\$\s*\z", "").alias("text"))
    # conditions on the path go below the parsing, but not below an inline: there each use of the path would parse the text again
    path_keys = F.split(F.substring_index("text", "\n", 1), "/")
    rows = texts.select("file", F.inline(F.array(F.struct("text", path_keys.alias("path"))))).filter(F.trim("text") != "")
    lines = F.split(F.col("text"), "\n")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.instr(x, ":") > 0)
    entry = lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.substr(x, F.instr(x, ":") + 1).alias("value"))
    # a column of its own: what a lambda captures is evaluated again for each element
    rows = rows.select("file", "path", F.transform(rest, entry).alias("__entries"))
    keys, n = F.col("__entries.key"), F.size("__entries")
    # of a key that comes twice the last value counts
    last = F.filter("__entries", lambda e, i: i == n - F.array_position(F.reverse(keys), e["key"]))
    kv = F.when(F.size(F.array_distinct(keys)) == n, F.map_from_entries("__entries")).otherwise(F.map_from_entries(last))
    return rows.select("file", "path", kv.alias("kv"))


def _objects(text: str) -> Column:
    """The JSON objects of a text, one a line or one after another on a line; blank lines count for nothing."""
    return F.filter(F.split(F.regexp_replace(text, r"\}\s*\{", "}\n{"), "\n"), lambda line: F.trim(line) != "")


def _header_time(json: str) -> Column:
    return F.get_json_object(json, "$.current_time").cast("long")


def sample_rows(records: DataFrame, record: str, text: str) -> DataFrame:
    """Record texts to a row per JSON object: record, pos, time_ms, json. A {"current_time":N} object gives its time to those after it."""
    rows = records.select(record, F.posexplode(_objects(text)).alias("pos", "json")).withColumn("__time", _header_time("json"))
    return carry_headers(rows, ["pos"], "__time", [record]).withColumnRenamed("__time", "time_ms")


def carry_headers(df: DataFrame, order: Sequence[str], header: str, partition: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows without a header of their own, each with the last header before it; rows before the first have null. ranges: cuts large records, see `operators.running`."""
    rows = running(df.withColumn("__is_header", F.col(header).isNotNull()), partition, order, upto={header: F.col(header)}, ranges=ranges)
    return rows.filter(~F.col("__is_header")).select(*df.columns)


def read_samples(spark: SparkSession, path: str, family: str | Family, between: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Sample records of a family, a file each: record, pos, time_ms, the family's columns, _corrupt for what can't be parsed.

    A file is read by parts, each by a task of its own. A part sums up its last header and its number of objects, and takes over
    those of the parts before it, so that no task holds a file and rows are those of the whole read. between: times [from, to)
    of rows that are wanted; others go before they are parsed. Objects don't go over several lines.
    """
    family = FAMILIES[family] if isinstance(family, str) else family
    at = F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("record"), at.alias("__part"), F.monotonically_increasing_id().alias("__line"), "value")
    objects = lines.select("record", "__part", "__line", F.posexplode(_objects("value")).alias("__at", "json")).withColumn("__header", _header_time("json"))
    rows = running(objects, ["record"], ["__line", "__at"], upto={"time_ms": F.col("__header")}, sums={"__n": F.lit(1)}, cut="__part").filter("__header IS NULL")
    first, end = between
    if first is not None:
        rows = rows.filter(F.col("time_ms") >= first)
    if end is not None:
        rows = rows.filter(F.col("time_ms") < end)
    return parsed(rows.select("record", (F.col("__n") - 1).cast("int").alias("pos"), "time_ms", "json"), family)


def parsed(rows: DataFrame, family: Family) -> DataFrame:
    """The column json to the family's typed columns and _corrupt."""
    schema = T.StructType([*family.schema.fields, T.StructField("_corrupt", T.StringType())])
    made = F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("__s", made).select(*[c for c in rows.columns if c != "json"], "__s.*")


def split_family(events: DataFrame, family: str, types: dict[str, str] | None = None) -> DataFrame:
    """Path keys to columns named as the family's keys, and _corrupt: the path if it has another number of keys or a key of another type."""
    keys, types = PATHS[family], types or {}
    fits = F.size("path") == len(keys)
    columns = {k: F.when(fits, F.try_element_at("path", F.lit(i + 1)).try_cast(types.get(k, "string"))) for i, k in enumerate(keys)}
    bad = reduce(lambda a, b: a | b, [c.isNull() for c in columns.values()])
    return events.withColumns(columns | {"_corrupt": F.when(bad, F.array_join("path", "/"))})


def quarantine(df: DataFrame, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a parsed DataFrame."""
    bad: Column = F.col(corrupt).isNotNull()
    return df.filter(~bad).drop(corrupt), df.filter(bad)


def write_good(df: DataFrame, write: Callable[[DataFrame], object], reasons: Mapping[str, Column] | None = None, corrupt: str = "_corrupt") -> dict[str, int]:
    """Gives the good rows of a parsed DataFrame to write, and returns how many were good and bad, and bad by reason, of the same pass.

    reasons: conditions on bad rows, such as path_reasons(family); a row may have several. write must read what it is given to its end, once.
    """
    bad = F.col(corrupt).isNotNull()
    seen = Observation(f"quarantine-{uuid.uuid4().hex}")
    counts = {"good": ~bad, "bad": bad} | {f"bad.{n}": bad & F.coalesce(c, F.lit(False)) for n, c in (reasons or {}).items()}
    write(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]).filter(~bad).drop(corrupt))
    return {n: v or 0 for n, v in seen.get.items()}


def path_reasons(family: str) -> dict[str, Column]:
    """Why split_family sets a path aside: its number of keys, or a key of another type."""
    fits = F.size("path") == len(PATHS[family])
    return {"arity": ~F.coalesce(fits, F.lit(False)), "type": fits}


def check_contract(raw: DataFrame, dims: Sequence[str], values: Sequence[str], json: str = "json", family: str | None = None) -> DataFrame:
    """Keys of JSON rows against those declared: (family,) key, kind (missing: not in all rows, unknown: not declared), n rows that lack or have it."""
    by = [family] if family else []
    declared = [*dims, *values]
    keys = F.array_distinct(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))
    lacks = F.transform(F.array_except(F.array(*map(F.lit, declared)), keys), lambda k: F.struct(k.alias("key"), F.lit("missing").alias("kind")))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, declared))), lambda k: F.struct(k.alias("key"), F.lit("unknown").alias("kind")))
    return raw.select(*by, F.inline(F.concat(lacks, extra))).groupBy(*by, "key", "kind").agg(F.count(F.lit(1)).alias("n"))
