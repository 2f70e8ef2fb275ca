"""Rows of a key packed by the tasks that read them, and put in order as columns.

Spark hands a stateful processor its rows one by one, each as a tuple of Python. Tasks that read a stream therefore pack
up to PACK rows of a key into one row of arrays, from one Arrow batch; the processor takes these apart as NumPy columns, sorts
them by columns and merges large keys from files of the task, block by block.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of one packed row: Spark puts up to 10,000 packed rows into a frame. Rows of a block, of which a file that is merged has one and a half in memory.
PACK, BLOCK = 64, 10_000
#: The column that marks which fields of a row are null.
BITS = "null_bits"

Block = dict[str, np.ndarray]


def pack(batch: pa.RecordBatch, n_keys: int, size: int = PACK) -> pa.RecordBatch:
    """Rows of a key (the first n_keys columns), up to size each, as one row with a list for each other column."""
    code = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:n_keys]:
        found = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    begins = np.diff(code[order], prepend=-1) != 0
    within = np.arange(len(order)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    first = np.flatnonzero(within % size == 0)
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in batch.columns[n_keys:]]
    return pa.RecordBatch.from_arrays([*[c.take(pa.array(order[first])) for c in batch.columns[:n_keys]], *lists], batch.schema.names)


def packed(given: DataFrame, n_keys: int) -> DataFrame:
    """A stream whose rows are packed by its first n_keys columns; the others have no nulls."""
    fields = given.schema.fields
    schema = T.StructType([*fields[:n_keys], *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields[n_keys:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pack(batch, n_keys)

    return given.mapInArrow(run, schema)


def unpacked(frames: Iterable[pd.DataFrame], names: Sequence[str]) -> Iterator[Block]:
    for frame in frames:
        yield {n: np.concatenate(frame[n].tolist()) for n in names}


def nulls(block: Block, field: int) -> np.ndarray:
    """Where a field, by its number, is null."""
    return (block[BITS] >> field & 1).astype(bool)


def _rows(block: Block) -> int:
    return len(block[BITS])


def _taken(block: Block, rows: np.ndarray | slice) -> Block:
    return {n: v[rows] for n, v in block.items()}


def _joined(blocks: Sequence[Block]) -> Block:
    return blocks[0] if len(blocks) == 1 else {n: np.concatenate([b[n] for b in blocks]) for n in blocks[0]}


def _order(block: Block, by: Sequence[tuple[str, int]]) -> np.ndarray:
    """Rows in order of fields (name and number), nulls first."""
    some_null, keys = block[BITS].any(), []
    for name, field in reversed(by):
        keys += [block[name], *[~nulls(block, field)] * bool(some_null)]
    return np.lexsort(keys)


def _chunks(blocks: Iterable[Block], by: Sequence[tuple[str, int]], chunk: int) -> Iterator[Block]:
    """Sorted blocks of at least chunk rows, but for the last."""
    held: list[Block] = []
    for block in blocks:
        held.append(block)
        if sum(map(_rows, held)) >= chunk:
            one, held = _joined(held), []
            yield _taken(one, _order(one, by))
    if held:
        one = _joined(held)
        yield _taken(one, _order(one, by))


def _parts(block: Block, size: int) -> Iterator[Block]:
    for i in range(0, _rows(block), size):
        yield _taken(block, slice(i, i + size))


def _filed(blocks: Iterable[Block]) -> IO[bytes]:
    file = tempfile.TemporaryFile()
    for block in blocks:
        pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
    return file


def _read(file: IO[bytes]) -> Iterator[Block]:
    end = file.tell()
    file.seek(0)
    while file.tell() < end:
        yield pickle.load(file)


def merged(sources: Sequence[Iterator[Block]], by: Sequence[tuple[str, int]], size: int = BLOCK) -> Iterator[Block]:
    """Blocks in order, from sources that are in order themselves.

    What is held goes as far as the last row of the source that is first to run out; a source is read on when half a block of it is left.
    """
    live, wanted = dict(enumerate(sources)), list(range(len(sources)))
    held: list[Block] = []
    owners: list[np.ndarray] = []
    while True:
        for i in wanted:
            block = next(live[i], None)
            if block is None:
                del live[i]
            else:
                held.append(block)
                owners.append(np.full(_rows(block), i))
        if not held:
            return
        one, owner = _joined(held), np.concatenate(owners)
        order = _order(one, by)
        one, owner = _taken(one, order), owner[order]
        last = np.full(len(sources), -1)
        np.maximum.at(last, owner, np.arange(len(owner)))
        cut = min((int(last[i]) for i in live), default=len(owner) - 1) + 1
        if cut:
            yield from _parts(_taken(one, slice(0, cut)), size)
        left = owner[cut:]
        held, owners = ([_taken(one, slice(cut, None))], [left]) if len(left) else ([], [])
        counts = np.bincount(left, minlength=len(sources))
        wanted = [i for i in live if counts[i] <= size // 2]


def blocks_in_order(blocks: Iterable[Block], by: Sequence[tuple[str, int]], chunk: int, files: int, size: int = BLOCK) -> Iterator[Block]:
    """Rows in order, of which a chunk, or a block and a half of each file, is held at a time."""
    chunks = _chunks(blocks, by, chunk)
    held, after = next(chunks, None), next(chunks, None)
    if held is None:
        return
    if after is None:
        yield from _parts(held, size)
        return
    made: list[IO[bytes]] = []
    with ExitStack() as opened:
        while held is not None:
            made.append(opened.enter_context(_filed(_parts(held, size))))
            held, after = after, next(chunks, None)
            if len(made) == files and held is not None:
                one = opened.enter_context(_filed(merged([_read(f) for f in made], by, size)))
                for file in made:
                    file.close()
                made = [one]
        yield from merged([_read(f) for f in made], by, size)
