"""Stateful processors that walk a key's rows in order of time.

Spark hands a processor the rows of a key in no order, as pandas frames of bounded size, and takes what it emits in such
frames one after another: a task holds one chunk of rows and one frame to emit, however many rows a key has.

* Without event time, rows are walked at the end of the micro-batch that brought them: they must not come late by more than that.
  They come packed, many rows of a key in one (`packed`), and are put in order as columns; chunks of a large key are sorted
  into files of the task, which are read side by side. Rows with a time column for the watermark, or a ttl, come one by one.
* With event time (`ordered`), rows go into slots of time in the state store (RocksDB, which spills to disk), and a slot waits
  for its timer: it is walked once the watermark has passed its end, so that rows are in order across micro-batches as well.
  What comes later still is dropped and counted by Spark.

In pandas, numbers with nulls are floats: numbers come with their nulls marked in a column of bits, and keys as text.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import islice
from typing import IO, Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .packed import BITS, Block, blocks_in_order, packed, unpacked

#: Rows of a key that are sorted at once; rows of a sorted file that are read at once, of a frame that is emitted; files that are read side by side.
CHUNK, BLOCK, EMITTED, FILES = 100_000, 1_000, 10_000, 128
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Slot of rows without a time, which come first.
_NO_TIME = -(1 << 62)


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store; a session that names another provider of its own keeps it."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKSDB)


@dataclass
class Walk:
    """What is done with a key's rows. Rows are tuples of `fields`; the state a tuple of `state`, or None at first.

    step: (state, row) to (state, rows to emit, after their keys). order: sort key of a row. time: a row's time in
    milliseconds, or None. keep_ms: how long after its last row's time the state of a silent key is kept (event time).
    by: the fields, numbers, that `order` goes by, nulls first; with them, rows without event time or ttl come packed. along: `step` for a
    block of rows as columns, (state, block) to (state, values and nulls of each column to emit, all numbers); for walks without
    event time or ttl, and then in place of `step`.
    """

    fields: T.StructType
    state: T.StructType
    emitted: T.StructType
    step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]] | None
    order: Callable[[tuple], Any]
    time: Callable[[tuple], int | None]
    slot_ms: int = 60_000
    keep_ms: int | None = None
    ordered: bool = False
    ttl_ms: int | None = None
    chunk: int = CHUNK
    by: Sequence[str] = ()
    along: Callable[[tuple | None, Block], tuple[tuple | None, list[tuple[np.ndarray, np.ndarray]]]] | None = None


def _filed(rows: Iterable[tuple]) -> IO[bytes]:
    """A temporary file of the task that holds rows, block by block."""
    file, rows = tempfile.TemporaryFile(), iter(rows)
    while block := list(islice(rows, BLOCK)):
        pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
    return file


def _read(file: IO[bytes]) -> Iterator[tuple]:
    end = file.tell()
    file.seek(0)
    while file.tell() < end:
        yield from pickle.load(file)


def in_order(rows: Iterator[tuple], order: Callable[[tuple], Any], chunk: int = CHUNK, files: int = FILES) -> Iterator[tuple]:
    """Rows in order, of which a chunk, or a block of each file, is held at a time."""
    held = sorted(islice(rows, chunk), key=order)
    if len(held) < chunk:
        yield from held
        return
    made: list[IO[bytes]] = []
    merged = lambda: heapq.merge(*map(_read, made), key=order)
    with ExitStack() as opened:
        while held:
            made.append(opened.enter_context(_filed(held)))
            if len(made) == files:
                one = opened.enter_context(_filed(merged()))
                for file in made:
                    file.close()
                made = [one]
            held = sorted(islice(rows, chunk), key=order)
        yield from merged()


class OrderedProcessor(StatefulProcessor):
    def __init__(self, walk: Walk, keys: Sequence[str]):
        self.walk = walk
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        w = self.walk
        self.handle = handle
        self.carried = handle.getValueState("carried", w.state, w.ttl_ms)
        self.latest = handle.getValueState("latest", "time long", w.ttl_ms) if w.keep_ms is not None else None
        self.waiting = handle.getMapState("waiting", "slot long", T.StructType([T.StructField("rows", T.ArrayType(w.fields))]))

    def _slot(self, row: tuple) -> int:
        time = self.walk.time(row)
        return _NO_TIME if time is None else time // self.walk.slot_ms

    def _put(self, rows: Sequence[tuple]) -> set[int]:
        """Adds rows to their slots; one read and write of a slot for all of its rows."""
        by_slot: dict[int, list[tuple]] = {}
        for r in rows:
            by_slot.setdefault(self._slot(r), []).append(r)
        for slot, new in by_slot.items():
            held = [tuple(r) for r in self.waiting.getValue((slot,))[0]] if self.waiting.containsKey((slot,)) else []
            self.waiting.updateValue((slot,), (held + new,))
        return set(by_slot)

    def _given(self, frames: Iterable[pd.DataFrame | Block]) -> Iterator[tuple]:
        """The rows of frames or blocks, with their nulls."""
        for frame in frames:
            for *values, bits in zip(*[frame[c].tolist() for c in [*self.walk.fields.names, BITS]], strict=True):
                yield tuple(None if bits >> i & 1 else v for i, v in enumerate(values)) if bits else tuple(values)

    def _stepped(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """What the steps through rows in order emit."""
        w = self.walk
        state = tuple(self.carried.get()) if self.carried.exists() else None
        last = None
        for row in rows:
            state, made = w.step(state, row)
            last = w.time(row) if w.time(row) is not None else last
            yield from made
        if state is not None:
            self.carried.update(state)
        if last is not None and w.keep_ms is not None:
            self._expire_after(last)

    def _walked(self, key: tuple, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        made = self._stepped(rows)
        while some := list(islice(made, EMITTED)):
            columns = [*([k] * len(some) for k in key), *zip(*some, strict=True)]
            names = [*self.keys, *self.walk.emitted.names]
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})

    def _expire_after(self, last: int) -> None:
        """A timer for the end of a silence; the one before is dropped."""
        before = self.latest.get()[0] if self.latest.exists() else None
        if before is None or last > before:
            if before is not None:
                self.handle.deleteTimer(before + self.walk.keep_ms + 1)
            self.latest.update((last,))
            self.handle.registerTimer(last + self.walk.keep_ms + 1)

    def _drained(self, upto: int) -> Iterator[tuple]:
        """Rows of the slots that end by a time, in order; only the slots' numbers are held together."""
        for slot in sorted(s[0] for s in self.waiting.keys()):  # noqa: SIM118
            if slot == _NO_TIME or (slot + 1) * self.walk.slot_ms <= upto:
                rows = [tuple(r) for r in self.waiting.getValue((slot,))[0]]
                self.waiting.removeKey((slot,))
                yield from sorted(rows, key=self.walk.order)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w = self.walk
        given = self._given(rows)
        if not w.ordered:
            yield from self._walked(key, in_order(given, w.order, w.chunk))
            return
        slots: set[int] = set()
        while held := list(islice(given, w.chunk)):
            slots |= self._put(held)
        for slot in slots:  # a row without a time waits for nothing
            self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + 1 if slot == _NO_TIME else (slot + 1) * w.slot_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        w, now = self.walk, timerValues.getCurrentWatermarkInMs()
        if w.ordered:
            yield from self._walked(key, self._drained(now))
        if w.keep_ms is not None and self.latest.exists() and self.latest.get()[0] + w.keep_ms < now:
            self.carried.clear()
            self.latest.clear()

    def close(self) -> None:
        pass


class PackedProcessor(OrderedProcessor):
    """For packed rows, without event time or ttl."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w = self.walk
        names = w.fields.names
        blocks = blocks_in_order(unpacked(rows, [*names, BITS]), [(n, names.index(n)) for n in w.by], w.chunk, FILES)
        if w.along is None:
            yield from self._walked(key, self._given(blocks))
            return
        state = tuple(self.carried.get()) if self.carried.exists() else None
        for block in blocks:
            state, made = w.along(state, block)
            if n := len(made[0][0]):
                columns = {k: pd.Series([v] * n, dtype=object) for k, v in zip(self.keys, key, strict=True)}
                yield pd.DataFrame(columns | {f: pd.Series(pd.arrays.IntegerArray(*c)) for f, c in zip(w.emitted.names, made, strict=True)})
        if state is not None:
            self.carried.update(state)


_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _as_text(key: T.StructField) -> Column:
    return F.col(key.name) if isinstance(key.dataType, T.StringType) else F.to_json(F.struct(F.col(key.name).alias("v")), _JSON).alias(key.name)


def _from_text(key: T.StructField) -> Column:
    if isinstance(key.dataType, T.StringType):
        return F.col(key.name)
    return F.from_json(key.name, T.StructType([T.StructField("v", key.dataType)]), _JSON)["v"].alias(key.name)


def walked(stream: DataFrame, keys: Sequence[str], walk: Walk) -> DataFrame:
    """What a walk emits of a stream, after its keys. Event times need a watermark on the stream."""
    use_rocksdb(stream.sparkSession)
    mode = "EventTime" if walk.ordered or walk.keep_ms is not None else "ProcessingTime" if walk.ttl_ms is not None else "None"
    held, fields = [stream.schema[k] for k in keys], walk.fields.fields
    none = lambda f: F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)
    bits = sum((F.col(f.name).isNull().cast("long") * (1 << i) for i, f in enumerate(fields)), F.lit(0).cast("long"))
    rest = [c for c in stream.columns if c not in keys and c not in walk.fields.names]
    given = stream.select(*map(_as_text, held), *[F.coalesce(f.name, none(f)).alias(f.name) for f in fields], bits.alias(BITS), *rest)
    emitted = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *walk.emitted.fields])
    by_block = bool(walk.by) and mode == "None" and not rest
    given, processor = (packed(given, len(keys)), PackedProcessor(walk, keys)) if by_block else (given, OrderedProcessor(walk, keys))
    made = given.groupBy(*keys).transformWithStateInPandas(processor, emitted, "Append", mode)
    return made.select(*map(_from_text, held), *walk.emitted.names)
