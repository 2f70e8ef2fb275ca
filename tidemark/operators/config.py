"""Folds over the history of configuration changes of many clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import FEATURES, feature_bit
from .running import running

KINDS = ("rcas", "deciders", "actions", "collectors")


def _mentions(history: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """cluster, ts, seq, kind, on, name: what accepted requests say of a component.

    A request that names a component on both sides of a kind is rejected whole, an empty one changes nothing.
    """
    rows = history
    for kind in KINDS:
        rows = rows.filter(~F.coalesce(F.arrays_overlap(f"enable.{kind}", f"disable.{kind}"), F.lit(False)))
    none = F.array().cast("array<string>")
    mentions = [F.struct(F.lit(kind).alias("kind"), F.lit(side == "enable").alias("on"), F.coalesce(f"{side}.{kind}", none).alias("names")) for kind in KINDS for side in ("enable", "disable")]
    said = rows.select(*cluster, "ts", "seq", F.inline(F.array(*mentions)))
    return said.select(*cluster, "ts", "seq", "kind", "on", F.explode("names").alias("name"))


def fold_overrides(history: DataFrame, as_of: int | None = None, cluster: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Effective enabled and disabled components by cluster and kind, sorted.

    history: cluster, ts, seq, and structs enable and disable with an array of names per kind.
    A request that names a component on both sides of a kind is rejected whole, an empty one
    changes nothing. Accepted requests don't overlap, so the last mention of a component decides.
    """
    said = _mentions(history if as_of is None else history.filter(F.col("ts") <= as_of), cluster)
    last = said.groupBy(*cluster, "kind", "name").agg(F.max_by("on", F.struct("ts", "seq")).alias("on"))
    names = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("name"))))
    return last.groupBy(*cluster, "kind").agg(names(F.col("on")).alias("enabled"), names(~F.col("on")).alias("disabled"))


def override_intervals(history: DataFrame, cluster: Sequence[str] = ("cluster_id",), ranges: int | None = None) -> DataFrame:
    """When each component was enabled: cluster, kind, name, from_ms, to_ms (null: still), one row from being enabled to being disabled.

    Mentions that change nothing join no new interval, nor does a mention whose time is that of the next one.
    Before its first mention a component is not enabled. history and rejection: as in fold_overrides. ranges: see `running`.
    """
    keys = [*cluster, "kind", "name"]
    # of mentions at one time the last counts
    said = _mentions(history, cluster).groupBy(*keys, "ts").agg(F.max_by("on", "seq").alias("on")).filter("ts IS NOT NULL")
    rows = running(said, keys, ["ts"], before={"__was": F.col("on")}, ranges=ranges)
    changes = rows.filter(F.col("on") != F.coalesce("__was", F.lit(False)))
    found = running(changes, keys, ["ts"], after={"to_ms": F.col("ts")}, ranges=ranges)
    return found.filter("on").select(*keys, F.col("ts").alias("from_ms"), "to_ms")


def fold_feature_state(history: DataFrame, cluster: str = "cluster_id", ranges: int | None = None) -> DataFrame:
    """Intervals [from_ms, to_ms) between changes of the state integer, per feature: enabled or not. The last one has no end.

    The pipeline follows its bit. Another feature follows its own, but is not switched on while the pipeline is off.
    Before their first change features are off. ranges: see `running`.
    """
    pipeline = feature_bit(F.col("state"), FEATURES[0])
    counts = {n: F.when(~((feature_bit(F.col("state"), n) == 1) & (pipeline == 0)), feature_bit(F.col("state"), n)) for n in FEATURES[1:]}
    rows = running(history, [cluster], ["ts", "seq"], upto={f"__{n}": c for n, c in counts.items()}, after={"to_ms": F.col("ts")}, ranges=ranges)
    on = {FEATURES[0]: pipeline == 1} | {n: F.coalesce(f"__{n}", F.lit(0)) == 1 for n in FEATURES[1:]}
    states = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("enabled")) for n, c in on.items()])
    return rows.select(cluster, F.col("ts").alias("from_ms"), "to_ms", F.inline(states))
