"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each source has a weight; its target is its share of all words, at most max_repeat
times what it has. A source takes whole rounds of itself while they fit, and of one more
round the documents whose hash lies under a threshold. The threshold is found from
histograms of words by source and hash bucket: the bucket in which the budget ends is
split again, and only that one, until it is a single hash value. That last value is
taken if this brings the source nearer to its target.

Null text has size 0, a null source is a source of its own and comes last, and documents
with one id (nulls too) have one hash and are taken together. Empty tables give empty
results. Results depend on the rows alone, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words_in

#: Bits of a document's hash, and those that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12


def id_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """From (source, source_size), stored: those and weight, target.

    Sources are ranked in code-point order by ranges, each of which counts for itself,
    so that no task ranks them all. What capped sources leave is dealt out again in
    rounds; a round is one sum over the sources, and only the sums reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    ranged = stored(totals.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", before.alias("__before"))  # a row per partition, however many sources there are
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranged.join(parts, "__part").withColumn("weight", F.element_at(cycle, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    ranked = stored(ranked.select("source", "source_size", "weight").withColumn("__cap", F.col("source_size") * max_repeat), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, shared, capped = total, None, -1
    above = F.lit(False)
    while True:
        got = ranked.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("__cap"))), F.lit(0)).alias("cap"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        rest, shared = total - got["cap"], got["weight"]
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(shared or 1))
        if got["n"] == capped:
            break
        capped, above = got["n"], above | (F.col("__cap") < share)
    return ranked.withColumn("target", F.when(above, F.col("__cap").cast("double")).otherwise(share)).drop("__cap")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): per row of docs doc_id, source, size, hash; per source its sizes, weight, target, rounds and threshold.

    A document is taken `rounds` times, and once more if its hash is below the threshold.
    """
    columns = {"doc_id": F.col(f"`{id_col}`"), "source": F.col(f"`{source_col}`"), "size": words_in(F.col(f"`{text_col}`")), "hash": id_hash(F.col(f"`{id_col}`"))}
    sizes = stored(docs.select(*[c.alias(name) for name, c in columns.items()]), "sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0)
    plan = targets.withColumn("rounds", rounds.cast("int"))
    plan = plan.withColumn("__budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = plan.select(F.col("source").alias("__source"), "__budget", F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__below"))
    for level in range(HASH_BITS // LEVEL_BITS):
        # stored, so that Spark knows that it has a row per source and need not shuffle the sizes
        state = stored(_refined(sizes, state, HASH_BITS - LEVEL_BITS * (level + 1)), f"level{level}")
    # the boundary is one hash value now; it goes in if that leaves less of a gap
    found = state.select("__source", F.when(2 * F.col("__below") + F.col("__held") <= 2 * F.col("__budget"), F.col("__prefix") + 1).otherwise(F.col("__prefix")).alias("threshold"))
    plan = plan.join(found, plan["source"].eqNullSafe(found["__source"]), "left").drop("__source", "__budget")
    return sizes, stored(plan.withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))), "plan")


def _refined(sizes: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Splits each source's boundary bucket: words by its 4,096 parts, and the part in which the budget ends."""
    inside = F.shiftright("hash", shift + LEVEL_BITS) == F.col("__prefix")
    rows = sizes.join(state, sizes["source"].eqNullSafe(state["__source"]) & inside)
    keys = ["__source", "__budget", "__below"]
    hist = rows.groupBy(*keys, F.shiftright("hash", shift).alias("__bucket")).agg(F.sum("size").alias("__held"))
    upto = F.sum("__held").over(Window.partitionBy(*keys).orderBy("__bucket")) + F.col("__below")
    hist = hist.withColumn("__upto", upto)
    # the first bucket that goes over the budget, or the last one if none does
    over = F.when(F.col("__upto") > F.col("__budget"), F.struct("__bucket", "__upto", "__held"))
    last = F.struct("__bucket", "__upto", "__held")
    edge = hist.groupBy(*keys).agg(F.coalesce(F.min(over), F.max(last)).alias("e"))
    return edge.select("__source", "__budget", F.col("e.__bucket").alias("__prefix"), (F.col("e.__upto") - F.col("e.__held")).alias("__below"), F.col("e.__held").alias("__held"))


def _copies(max_repeat: int) -> Column:
    """Times that the plan takes a document; one without words, which fills no budget, is taken no more often than the others may be."""
    return F.least(F.col("rounds") + (F.col("hash") < F.col("threshold")).cast("int"), F.lit(max_repeat))


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", max_repeat: int = 3) -> DataFrame:
    """Each row of docs as often as the plan takes it, max_repeat times at most."""
    plan = plan.select(F.col("source").alias("own"), "rounds", "threshold")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source_col}`").alias("source"), id_hash(F.col(f"`{id_col}`")).alias("hash"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("copies", _copies(max_repeat))
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, source, weight, copies."""
    sizes, plan = mixing_plan(docs, weights, max_repeat, id_col, text_col, source_col)
    plan = plan.withColumnRenamed("source", "__source")
    copies = _copies(max_repeat)
    return sizes.join(plan, sizes["source"].eqNullSafe(plan["__source"])).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", "weight", copies.alias("copies")
    )
