"""Bounded work per tick: rotating samples and the largest trackers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unused


def rotating_sample(keys: DataFrame, by: Sequence[str], order: Sequence[str], ticks: int, n: int) -> DataFrame:
    """Which keys each tick from 0 on handles: per owner (by) the next n of its ordered list, which begins again at its end.

    The last tick of a round may be short; n of 0 or less gives nothing. Owners hold their own lists, so that no list is global.
    """
    if n <= 0:
        return keys.withColumn("tick", F.lit(0)).limit(0)
    rows = keys.withColumn("__slot", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / n))
    owners = keys.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / n).alias("__slots"))
    turns = owners.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1)))).withColumn("__slot", F.pmod("tick", "__slots")).drop("__slots")
    return rows.join(turns, [*by, "__slot"]).drop("__slot")


def hot_shards(trackers: DataFrame, by: Sequence[str], size: str, tiebreak: Sequence[str], limit: int = 50) -> DataFrame:
    """Per snapshot (by) the limit trackers with the largest size."""
    n = unused(trackers.columns, "__n")
    return trackers.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(size).desc(), *tiebreak))).filter(F.col(n) <= limit).drop(n)
