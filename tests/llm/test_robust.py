"""Damage, extremes and names that operators must take: none of them ends or hangs a job."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, secrets, simhash, substring_dedup, tiff, token_counts, toxicity, warc, wide_simhash
from tidemark.llm.queries import public_tokenizers

# --- WARC


def record(page: bytes, *headers: str) -> bytes:
    block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *headers]).encode() + b"\r\n\r\n" + page
    return warc.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/")], block)


def text_of(page: bytes, *headers: str) -> str:
    return {r[0]: r for r in warc.derive(record(page, *headers))}["conversion"][9]


def test_references_of_any_length():
    assert text_of(b"a &#" + b"9" * 5000 + b"; b &#x" + b"f" * 9000 + b" c") == "a � b � c"
    assert text_of(b"&#" + b"0" * 6000 + b"65;&#x" + b"0" * 6000 + b"42;&#0;&#;&#x;&amp;&#38;") == "AB�&#;&#x;&&"


@pytest.mark.parametrize("size", [b"-6", b"+6", b"1_0", b"", b"zz", b"f" * 40])
def test_chunk_sizes_that_are_none(size):
    body = b"5\r\nhello\r\n" + size + b"\r\nworld\r\n0\r\n\r\n"
    assert "hello" in text_of(body, "Transfer-Encoding: chunked")


def test_bodies_that_unpack_without_end(monkeypatch):
    import gzip
    import zlib

    monkeypatch.setattr(warc, "LARGEST", 1 << 20)
    large = b"x" * (3 << 20)
    for coding, data in (("gzip", gzip.compress(large)), ("deflate", zlib.compress(large))):
        [row] = warc.derive(record(data, f"Content-Encoding: {coding}"))
        assert row[0] is None and "unpacks to more" in row[-1]
        assert text_of(gzip.compress(b"ok") if coding == "gzip" else zlib.compress(b"ok"), f"Content-Encoding: {coding}") == "ok"
        assert text_of(data[:40], f"Content-Encoding: {coding}")  # cut short: as it is


@pytest.mark.parametrize("piece", ["<a ", "<p", "<a href=\"", "<a href='x", "<script", "<script>", "<!--", "<title>", "&#", "</script", "<a href=   ", "<style></style  "])
def test_pages_in_linear_time(piece):
    page = (piece * (1_000_000 // len(piece))).encode()
    began = time.process_time()
    assert len(warc.derive(record(page))) == 2
    assert time.process_time() - began < 4


def test_tags_as_before():
    page = "<TITLE>T&amp;t</title><p>one<b>two</b> three<br/>x < y <3 <script>if (a<b) '</p>'</SCRIPT ><!-- <p> -->four<a href='/q?a>b'>l</a><img alt=x src=i.png><template><p>no</template>five<noscript>"
    rows = {r[0]: r[9] for r in warc.derive(record(page.encode()))}
    assert rows["conversion"].split("\n") == ["onetwo three", "x < y <3 fourb'>l five"]
    assert '"Title": "T&t"' in rows["metadata"] and "http://a/q?a>b" in rows["metadata"] and "IMG@/src" in rows["metadata"]


def test_derivatives_as_a_job(spark):
    pages = ["a &#" + "9" * 5000, None, "", "<a " * 20_000, "plain"]
    df = spark.createDataFrame([(i, None if i == 1 else "http://x/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses(df), "page_id").collect()
    assert len(got) == 10 and all(r["error"] is None for r in got)


# --- TIFF


def directory(entries, big=False):
    """A file with one directory of (tag, type, count, raw value)."""
    order = "<HHQ8s" if big else "<HHI4s"
    head = b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) if big else b"II*\0" + struct.pack("<I", 8)
    return head + struct.pack("<Q" if big else "<H", len(entries)) + b"".join(struct.pack(order, t, k, n, v.ljust(8 if big else 4, b"\0")) for t, k, n, v in entries) + bytes(8 if big else 4)


GOOD = [(256, 4, 1, struct.pack("<I", 2)), (257, 4, 1, struct.pack("<I", 2)), (258, 3, 1, b"\x08"), (259, 3, 1, b"\x01"), (273, 4, 1, struct.pack("<I", 8)), (278, 4, 1, struct.pack("<I", 2)), (279, 4, 1, struct.pack("<I", 4))]


def test_headers_that_hold_no_number(spark):
    bad = {
        "none": directory([(256, 4, 0, b""), *GOOD[1:]]), "nan": directory([(256, 11, 1, struct.pack("<f", float("nan"))), *GOOD[1:]]), "real": directory([(256, 11, 1, struct.pack("<f", 3.5)), *GOOD[1:]]),
        "large": directory([(256, 16, 1, struct.pack("<Q", (1 << 64) - 1)), *[(t, k, n, v) for t, k, n, v in GOOD[1:]]], big=True), "negative": directory([(256, 9, 1, struct.pack("<i", -1)), *GOOD[1:]]),
        "offsets": directory([*GOOD[:4], (273, 11, 1, struct.pack("<f", 8.0)), *GOOD[5:]]), "rows": directory([*GOOD[:5], (278, 4, 0, b""), GOOD[6]]),
    }
    df = spark.createDataFrame([*bad.items(), ("good", directory(GOOD))], "path string, content binary")
    got = {r["path"]: r for r in tiff.tiff_pages(df).collect()}
    assert set(got) == {*bad, "good"}
    assert got["good"]["error"] is None and len(got["good"]["pixels"]) == 4
    assert all(got[n]["error"] and got[n]["pixels"] is None for n in bad)


def test_directories_of_any_kind():
    """Random tags, types, counts and values, each in a directory of its own."""
    rng = random.Random(4)
    tags = [t for t, *_ in GOOD] + [262, 266, 277, 284, 317, 322, 323, 324, 325]
    for _ in range(3000):
        big = rng.random() < 0.3
        entries = dict.fromkeys(rng.sample(tags, rng.randrange(1, 14)))
        made = [(t, rng.randrange(20), rng.choice([0, 1, 1, 1, 2, 7, 1 << 31]), rng.choice([bytes(8), rng.randbytes(8), struct.pack("<Q", rng.choice([1, 2, 8, 255, 1 << 31, (1 << 64) - 1])), struct.pack("<d", rng.choice([float("nan"), 3.5, -1e300]))])[: 8 if big else 4]) for t in entries]
        if rng.random() < 0.5:
            made = [next((m for m in made if m[0] == g[0] and rng.random() < 0.3), g) for g in GOOD] if not big else made
        for page in tiff.pages_of(directory(made, big)):
            assert (page.pixels is None) != (page.error is None)
            assert all(0 <= v < 1 << 31 for v in (page.width, page.height, page.samples, page.bits))


# --- secrets


def test_long_runs_in_linear_time():
    text = "eyJ" * 350_000 + ".eyJ" + "eyJ" * 10 + " eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"
    began = time.process_time()
    [found] = secrets.Scanner(secrets.ADDED).spans([text])
    assert time.process_time() - began < 3
    assert [text[a:b] for kind, a, b in found if kind == "web_token"] == ["eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"]


# --- exact dedup


def test_copies_that_share_an_id(spark):
    """20,000 rows of a null id and one text, and of one id and another: dealt over tasks, one of each kept."""
    n = 20_000
    df = spark.range(2 * n).select(F.when(F.col("id") % 2 == 1, F.lit(7)).alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit("b")).otherwise("a").alias("text"))
    df = df.unionByName(spark.createDataFrame([(7, "a"), (8, "c"), (None, None), (None, ""), (7, "c")], "doc_id int, text string"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("false", "-1", "16")):
        spark.conf.set(k, v)
    try:
        got = exact_dedup.exact_groups(df)
        parts = got.filter("doc_id IS NULL AND group_size > 10").groupBy(F.spark_partition_id()).count().collect()
        rows = got.groupBy("doc_id", "keep_id", "group_size").agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(parts) > 6 and max(r["count"] for r in parts) < n / 3
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["n"]) for r in rows) == [
        ("7", "7", n, 1, n), ("7", "7", n + 1, 1, 1), ("7", "8", 2, 0, 1), ("8", "8", 2, 1, 1), ("None", "7", n + 1, 0, n), ("None", "None", 2, 1, 2),
    ]


# --- names and types of columns


@pytest.fixture(scope="module")
def odd(spark):
    """Columns with dots, inner names and a map; null ids, texts and sources, repeated rows."""
    texts = ["one two three four " * 30, "one two three four " * 30, "a b c d e f g", None, "", "x " * 3000, "one two three four " * 30]
    rows = [(None if i == 3 else i % 6, t, "en", None if i == 4 else f"s{i % 3}", 1.0, "t", {"k": i % 2}, 5) for i, t in enumerate(texts)]
    rows += [rows[2], rows[3], rows[5]]
    return spark.createDataFrame(rows, "`a.b` long, text string, lang string, source string, __score double, __text string, m map<string,int>, score int")


def test_operators_take_any_names(spark, odd):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    n = odd.count()
    for f in (
        lambda d: secrets.find_secrets(d, id_col="a.b"), lambda d: token_counts.token_counts(d, path, id_col="a.b"), lambda d: tiff.text_media(d, id_col="a.b"), lambda d: substring_dedup.without_repeats(d, id_col="a.b"),
        lambda d: simhash.near_components(d, id_col="a.b"), lambda d: exact_dedup.exact_groups(d, "a.b"),
    ):
        got = f(odd)
        assert got.count() == n and got.columns[0] == "a.b"
        assert f(odd.limit(0)).count() == 0


def test_stages_take_any_names(spark, odd):
    labels = spark.createDataFrame([(i, int(i == 2)) for i in range(6)], "`a.b` long, toxic int")
    for f in (lambda d: toxicity.clean(d, labels, id_col="a.b"), lambda d: exact_dedup.exact_dedup(d, "a.b"), lambda d: simhash.near_dedup(d, "a.b"), lambda d: wide_simhash.near_dedup(d, "a.b")):
        got = f(odd)
        assert got.schema.names == odd.schema.names and [t for _, t in got.dtypes] == [t for _, t in odd.dtypes]
        assert 0 < got.count() <= odd.count()
        assert f(odd.limit(0)).count() == 0


def test_the_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Null ids, texts and sources, empty texts, repeated rows and extra columns through all stages; then none at all."""
    docs = odd.withColumnRenamed("a.b", "doc_id").withColumn("n_chars", F.length("text").cast("long")).withColumn("x.y", F.lit(1))
    spark.createDataFrame([(i, int(i == 2)) for i in range(6)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        at = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, at, f"file://{tmp_path}")
            if k < 4:
                assert made.columns == docs.columns
            out = f"file://{tmp_path}/{k}-{given is docs}"
            made.write.parquet(out)
            at = spark.read.schema(made.schema).parquet(out)
        assert (at.count() > 0) == (given is docs)
