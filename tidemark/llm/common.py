"""What the corpus operators share: stored intermediate tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one step of a task holds in arrays at a time.
STEP_BYTES = 2 << 20

def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_in(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that hold maps count as text."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def steps(batch: pa.RecordBatch, column: str | int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about limit bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def map_texts(docs: DataFrame, keep: list[str], text_col: str, fields: T.StructType, fn: Callable[[list[str | None]], dict[str, pa.Array]]) -> DataFrame:
    """Columns `keep` of docs and, per row, what fn makes of a list of whole texts."""
    # columns go by place: a name may hold anything, or come twice
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    made = T.StructType([T.StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)])
    schema = T.StructType([*given.schema.fields[: len(keep)], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, len(keep)):
                found = fn(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[found[f.name] for f in fields]], schema.names)

    return given.mapInArrow(run, schema).toDF(*keep, *fields.names)
