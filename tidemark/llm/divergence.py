"""Source divergence audit: how far the sources of a language are apart by their terms, and which terms tell a source.

A term is a run of letters and characters beyond ASCII, A-Z as a-z. A language keeps the terms
that at least MIN_DOCS of its documents have, V of them. The share of a term in a group (a source of a language, or all of the
language) is a whole number of billionths with 5 added to each count: 1 + floor(1e9 * (count + 5) / (N + 5 * V)).

1. Partial counts: within mapInArrow, a chunk of texts goes through Arrow's kernels: ascii_lower,
   split_pattern_regex, dictionary_encode, and a hash group_by by (text, term), then by (language, source, term), which
   gives occurrences and documents. Python sees no text and no term.
2. Partial counts are dealt by (language, term) and merged; terms of too few documents go. A hot
   source or term is one row for each chunk by then.
3. Merged columnar shards: the kept terms of a language are dealt into shards of a bounded number of
   counts. A shard is a matrix of terms by sources. It gives the sum of differences of each two
   sources, and the TOP terms of each source that stand out most; sums and tops of shards are combined.

All arithmetic is on whole numbers: division goes three digits at a time, so that no
product leaves 64 bits as long as a language has fewer than 9e15 terms.

Null text, language and source count as empty. A group without terms is a group all the same; where V
is 0 its pairs have the value 0. Ranks go by value, then by the item's UTF-8 bytes, so there are no
ties. Repeated rows count each. An empty table gives no rows. A text is held whole by its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, stored

#: Documents of its language that a kept term is in, and what is added to each count.
MIN_DOCS, ADDED = 30, 5
#: A share of 1; and how many terms of each source are listed.
WHOLE, TOP = 1_000_000_000, 50
#: Bytes of text that go through Arrow's kernels at a time; counts of a shard's matrix.
CHUNK_BYTES, CELLS = 8 << 20, 1 << 16
#: What parts terms in lower-cased text.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"


def chunk_counts(part: pa.RecordBatch) -> pa.Table:
    """From lang, source, text: lang, source, term, n (occurrences), docs (texts that have it)."""
    split = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), BETWEEN)
    row, term = pc.list_parent_indices(split), split.flatten()
    some = pc.not_equal(term, "")
    coded = term.filter(some).dictionary_encode()
    by_text = pa.table([row.filter(some), coded.indices], names=["row", "code"]).group_by(["row", "code"]).aggregate([([], "count_all")])
    langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    group = pc.add(pc.multiply(langs.indices.cast(pa.int64()), len(sources.dictionary)), sources.indices.cast(pa.int64()))
    found = pa.table([group.take(by_text.column("row").combine_chunks()), by_text.column("code"), by_text.column("count_all")], names=["group", "code", "n"])
    found = found.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    lang, source = (pa.array(x) for x in np.divmod(found.column("group").to_numpy(), max(1, len(sources.dictionary))))
    counts = [langs.dictionary.take(lang), sources.dictionary.take(source), coded.dictionary.take(found.column("code").combine_chunks()), found.column("n_sum").combine_chunks(), found.column("count_all").combine_chunks()]
    return pa.table([c.cast(t) for c, t in zip(counts, _COUNTS.types, strict=True)], schema=_COUNTS)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), by chunk of texts; and a row without a term for each lang and source of a task."""
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    keys = pa.schema([_COUNTS.field(0), _COUNTS.field(1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = keys.empty_table()
        for batch in batches:
            groups = pa.concat_tables([groups, pa.table([batch.column("lang"), batch.column("source")], schema=keys)]).group_by(["lang", "source"]).aggregate([])
            for part in steps(batch, "text", CHUNK_BYTES):
                yield from chunk_counts(part).to_batches(max_chunksize=1 << 16)
        zero = pa.array(np.zeros(groups.num_rows, np.int64))
        yield from pa.table([groups.column("lang"), groups.column("source"), pa.nulls(groups.num_rows, pa.string()), zero, zero], schema=_COUNTS).to_batches()

    return given.mapInArrow(run, T.StructType.fromDDL("lang string, source string, term string, n bigint, docs bigint"))


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * kept)), three digits at a time."""
    by = total + ADDED * kept
    whole, rest = np.divmod(count + ADDED, by)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + digits
    return whole + 1


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def shard_divergence(terms: pa.Table, groups: pa.Table, top: int = TOP) -> pa.Table:
    """Of a shard of a language's terms: the sum of differences of each two sources, and each source's top terms.

    terms: term, sources (array of source numbers), counts (as many). groups: lang, source, number, total
    (N of the source), all_total (N of the language), kept (V), for each source of the language.
    """
    groups = groups.sort_by("number")
    lang, names = groups.column("lang")[0].as_py(), groups.column("source").to_pylist()
    totals, kept, all_total = groups.column("total").to_numpy(), groups.column("kept")[0].as_py(), groups.column("all_total")[0].as_py()
    n, out = len(names), []
    if not terms.num_rows:
        pairs = [(lang, a, "pair", b, 0) for a in names for b in names if a != b] if not kept else []
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True) if pairs else [[]] * 5, _FOUND.types, strict=True)], schema=_FOUND)
    listed = terms.column("sources").combine_chunks()
    counts = np.zeros((terms.num_rows, n), np.int64)
    counts[pc.list_parent_indices(listed).to_numpy(), listed.flatten().to_numpy()] = terms.column("counts").combine_chunks().flatten().to_numpy()
    p = share(counts, totals[None, :], kept)
    for i in range(n):
        apart = np.abs(p - p[:, i : i + 1]).sum(axis=0)
        out += [(lang, names[i], "pair", names[j], int(apart[j])) for j in range(n) if j != i]
    over = p - share(counts.sum(axis=1), all_total, kept)[:, None]
    words = terms.column("term").combine_chunks()
    ordered = np.argsort(pc.rank(words.cast(pa.binary()), "ascending", tiebreaker="first").to_numpy())
    for i in range(n):
        held = ordered[(counts[ordered, i] > 0) & (over[ordered, i] > 0)]
        best = held[np.argsort(-over[held, i], kind="stable")[:top]]
        out += [(lang, names[i], "term", words[int(t)].as_py(), int(over[t, i])) for t in best]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _FOUND.types, strict=True)], schema=_FOUND)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: item is another source of the language, value how far apart they are. Part term: item is a term that the source has more of than its language, ranks to `top`."""
    parts = partial_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    merged = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    listed = stored(listed.filter((F.col("docs") >= min_docs) | F.col("term").isNull()), "terms")
    terms = listed.filter("term IS NOT NULL")
    sizes = terms.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = listed.filter("term IS NULL").select("lang", F.inline("by_source")).drop("n").join(sizes, ["lang", "source"], "left").fillna(0, ["total"])
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    by_lang = Window.partitionBy("lang")
    groups = sources.join(kept, "lang", "left").fillna(0, ["kept"])
    groups = groups.withColumns({"number": F.row_number().over(by_lang.orderBy("source")) - 1, "all_total": F.sum("total").over(by_lang), "n_sources": F.count(F.lit(1)).over(by_lang)})
    groups = stored(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("n_sources") / cells)).cast("int")), "groups")
    numbered = terms.select("lang", "term", F.inline("by_source")).join(groups.select("lang", "source", "number", "shards"), ["lang", "source"])
    left = numbered.groupBy("lang", "term").agg(F.first("shards").alias("shards"), F.collect_list(F.struct("number", "n")).alias("c"))
    left = left.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", F.col("c.number").alias("sources"), F.col("c.n").alias("counts"))
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    schema = T.StructType.fromDDL("lang string, source string, part string, item string, value bigint")
    found = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(lambda terms, groups: shard_divergence(terms, groups, top), schema)
    # a term is in one shard alone, a pair in all of its language
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).cast("int"))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
