"""Column functions, all made of built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features of the state integer, from bit 0 on.
FEATURES = ("pipeline", "rca", "logging", "batch")
#: Shard states in which an index buffer counts.
BUFFERING = ("RECOVERING", "POST_RECOVERY", "STARTED")


def bucket(ms: Column, interval_ms: int) -> Column:
    """Start of the interval that holds a time in milliseconds; times before 1970 too."""
    return ms - F.pmod(ms, F.lit(interval_ms))


def task_type(source: Column) -> Column:
    """Text before the first space, or all of it."""
    return F.substring_index(source, " ", 1)


def task_metadata(source: Column) -> Column:
    """Text from the first space on, the space included, or the empty text."""
    at = F.instr(source, " ")
    return F.when(at == 0, F.lit("")).otherwise(F.substr(source, at))


def double_from_bits(bits: Column) -> Column:
    """The double whose IEEE 754 bits are in a long."""
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def index_buffer_bytes(state: Column, writing: Column, ram: Column) -> Column:
    """Writing and RAM bytes of a shard that recovers or has started, else 0; also where the shard is unknown."""
    return F.when(state.isin(*BUFFERING), F.coalesce(writing, F.lit(0)) + F.coalesce(ram, F.lit(0))).otherwise(F.lit(0))


def feature_bit(state: Column, feature: str) -> Column:
    """1 or 0: whether the feature's bit is set."""
    return F.getbit(state, F.lit(FEATURES.index(feature))).cast("int")


def unused(columns: Sequence[str], name: str) -> str:
    """A column name that none of the given ones has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
