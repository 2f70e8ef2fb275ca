"""Exact deduplication by salted combining, in DataFrame operations only.

Texts are compared whole, without any normalisation; a null text counts as empty.
Copies are combined three times: within each task (the partial aggregate), within each
salt of a digest, and across the salts of a digest. All texts take this way, and every
step groups by the text itself beside its digest, so that texts with one digest stay apart.

A row finds its winner again by its text's address (two unrelated digests and the length),
which the combining has shown to name one text only; where an address names several,
rows find theirs by the text.

Of equal texts the row with the largest id stays; null ids lose to any other. Rows
that repeat an id and a text count in group_size, and one of them stays: they are numbered where they
are read, and the one with the smallest number stays, so that they are never brought together. An empty
table gives an empty result. Extra columns are not touched, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, stored

#: Parts that the copies of a text are dealt into. At most 63, as they are bits of a long.
SALTS = 32

_ADDRESS = ["__sha", "__xx", "__length"]


def _address(text: Column) -> dict[str, Column]:
    return {"__sha": F.sha2(text, 256), "__xx": F.xxhash64(text), "__length": F.octet_length(text)}


def _salt(key: Column, salts: int) -> Column:
    if not 1 <= salts <= 63:
        raise ValueError("salts must be from 1 to 63")
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def _combined(rows: DataFrame) -> DataFrame:
    """From (__id, __text, __salt, address): a row per distinct text with its address, __keep (largest id), __n (rows) and __salts (bits of those that have it)."""
    by_salt = rows.groupBy("__salt", *_ADDRESS, "__text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    return by_salt.groupBy(*_ADDRESS, "__text").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"), F.expr("bit_or(shiftleft(1L, __salt))").alias("__salts"))


def _found(rows: DataFrame, winners: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Each row with its winner. A winner goes to the salts that have its text, so that the join is dealt out as evenly as the combining was."""
    dealt = winners.withColumn("__salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (__salts & shiftleft(1L, s)) != 0)"))).drop("__salts")
    joined = rows.join(dealt, ["__salt", *on])
    kept = F.col("__id").eqNullSafe(F.col("__keep")) & F.col("__one")
    return joined.select("__id", F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), kept.alias("kept"), "__sha")


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows that repeat no other's id and text; those that do, if any, with a number each; and the addresses of those. All with __one: whether a row is the first of its id and text."""
    by = ["__id", "__xx", "__length"]
    times = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__times")).filter("__times > 1")
    repeats = stored(times.select(*[F.col(c).alias(f"{c}_") for c in by]), "repeats")
    if repeats.isEmpty():
        return rows.withColumn("__one", F.lit(True)), None, repeats
    same = F.col("__id").eqNullSafe(F.col("__id_")) & (F.col("__xx") == F.col("__xx_")) & (F.col("__length") == F.col("__length_"))
    # numbers are taken once and written, so that they stay with their rows
    some = stored(rows.join(repeats, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "repeated")
    first = some.groupBy("__id", "__text").agg(F.min("__row").alias("__first")).select("__first")
    some = some.join(first, F.col("__row") == F.col("__first"), "left").withColumn("__one", F.col("__first").isNotNull()).drop("__first")
    return rows.join(repeats, same, "left_anti").withColumn("__one", F.lit(True)), some, repeats


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, address: Callable[[Column], dict[str, Column]] = _address) -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, text_sha256. address: the columns __sha, __xx and __length of a text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text")).withColumns(address(F.col("__text")) | {"__salt": _salt(F.col("__id"), salts)})
    by_address = _combined(rows).groupBy(*_ADDRESS).agg(F.count(F.lit(1)).alias("__texts"), *[F.max(c).alias(c) for c in ("__keep", "__n", "__salts")])
    winners = stored(by_address, "winners")
    single = winners.filter("__texts = 1").drop("__texts")
    own, repeated, repeats = _once(rows)
    found = _found(own.drop("__text"), single, _ADDRESS, salts)
    if repeated is not None:
        # rows of one id are dealt out by their numbers, and their winners go to all salts
        theirs = single.join(repeats.select(F.col("__xx_").alias("__xx"), F.col("__length_").alias("__length")).distinct(), ["__xx", "__length"], "left_semi").withColumn("__salts", F.lit((1 << salts) - 1))
        found = found.union(_found(repeated.drop("__text").withColumn("__salt", _salt(F.col("__row"), salts)), theirs, _ADDRESS, salts))
        own = own.unionByName(repeated.drop("__row"))
    several = winners.filter("__texts > 1").select(*_ADDRESS)
    if not several.isEmpty():
        some = own.join(several, _ADDRESS, "left_semi")
        found = found.union(_found(some, _combined(some), [*_ADDRESS, "__text"], salts))
    return found.withColumnsRenamed({"__id": id_col, "__sha": "text_sha256"})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Winners carry their rows through the combining, so that nothing is joined. Of rows that
    repeat both id and text, the one with the smallest hash of its columns stays.
    """
    own, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(own.isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    rows = docs.select(
        F.coalesce(own, F.lit("")).alias("__text"), row.alias("__row"), F.struct(key.alias("id"), F.bitwise_not(row_hash(docs)).alias("rest")).alias("__order"), _salt(key, salts).alias("__salt")
    ).withColumns(_address(F.col("__text")))
    best = lambda: (F.max_by("__row", "__order").alias("__row"), F.max("__order").alias("__order"))
    won = rows.groupBy("__salt", *_ADDRESS, "__text").agg(*best()).groupBy(*_ADDRESS, "__text").agg(*best())
    place = {c: F.col(f"__row.c{i}") for i, c in enumerate(rest)} | {text_col: F.when(~F.col("__row.none"), F.col("__text"))}
    return won.select(*[place[c].alias(c) for c in docs.columns])
