"""The registered corpus queries, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, exact_dedup, hard_negatives, mixing, packing, secrets, simhash, substring_dedup, tiff, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")), "page_id")
    # the record itself holds the block once more: its digest and length tell it
    return found.withColumn("record_sha256", F.sha2("record", 256)).withColumn("record_bytes", F.octet_length("record").cast("long")).drop("record")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(_number, base), F.sha2(_listed(of_base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit("spans")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_tiff": op6_tiff,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_decontamination": op11_decontamination,
    "op12_divergence": op12_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    # A word goes if one of the 50 windows that cover it starts in an earlier document.
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, generate_subscripts(h, 1) AS pos, unnest(h) AS h
            FROM (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM d)
        ), f AS (
            SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM p
        ), r AS (
            SELECT doc_id, list(pos ORDER BY pos) AS places FROM f WHERE again GROUP BY doc_id
        ), c AS (
            SELECT DISTINCT doc_id, unnest(flatten(list_transform(places, lambda i: range(i, i + 50)))) AS gone FROM r
        ), k AS (
            SELECT doc_id, count(*) AS n_removed, list(gone) AS gone FROM c GROUP BY doc_id
        ), e AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
        ), l AS (
            SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS kept
            FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.pos = c.gone GROUP BY e.doc_id
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
    """,
    # Sources in order of what they have by weight: the first ones are those above their cap.
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM d GROUP BY source
        ), c AS (
            SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
                   coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM s
        ), f AS (
            SELECT *, cap < (total - before)::DOUBLE * weight / rest::DOUBLE AS above FROM c
        ), g AS (
            SELECT sum(CASE WHEN above THEN 0 ELSE weight END)::DOUBLE AS shared,
                   (max(total) - sum(CASE WHEN above THEN cap ELSE 0 END))::DOUBLE AS remaining
            FROM f
        ), t AS (
            SELECT source, source_size, CASE WHEN above THEN cap::DOUBLE ELSE remaining * weight / coalesce(nullif(shared, 0), 1) END AS target
            FROM f, g
        ), r AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS rounds FROM t
        ), h AS (
            SELECT source, hash, sum(size) AS held FROM d GROUP BY source, hash
        ), u AS (
            SELECT *, sum(held) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h
        )
        SELECT d.doc_id, d.size, r.source_size, r.target, d.source,
               (d.size * (r.rounds + CASE WHEN 2 * u.upto - u.held <= 2 * (r.target - r.rounds * r.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.hash = u.hash
    """,
    # Windows of each length that items have, in every document.
    "op11_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), i AS (
            SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS h
            FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0)
        ), p AS (
            SELECT doc_id, n, generate_subscripts(h, 1) AS pos, unnest(h) AS h
            FROM (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')) AS h FROM d, (SELECT DISTINCT n FROM i))
        ), o AS (
            SELECT doc_id, pos, p.n, item_id FROM p JOIN i ON p.h = i.h AND p.n = i.n
        ), c AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM o) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
    """,
    # Counts of every group, source and kept term, zeros included.
    "op12_divergence": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents
        ), t AS (
            SELECT doc_id, lang, source, unnest(w) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30
        ), l AS (
            SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY lang
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
        ), s AS (
            SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
        ), p AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                   1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.total + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
            FROM s JOIN l ON s.lang = l.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), a AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ), f AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value
            FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f
        )
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50
    """,
    "op13_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        QUALIFY rank <= 5
    """,
}
