"""Registered corpus queries over whole tables against plain versions."""

import hashlib
import json
from collections import defaultdict

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm.test_dedup import plain_print
from tests.llm.test_media import Plain
from tests.llm.test_mixing_packing import plain_best_fit
from tidemark.llm import packing, queries, simhash, warc

FOLDER = "/root/testdata/sf0.01"


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def test_packing_of_all_documents(spark):
    """Every word stands once in a sequence, and groups are packed as the plain best fit packs them."""
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in table("documents")}
    got = queries.op4_packing(spark, FOLDER).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["bin_id"]].append(r)
    most = packing.LENGTHS[-1]
    assert {d: sorted(p) for d, p in pieces.items()} == {d: [(a, min(most, n - a)) for a in range(0, n, most)] or [(0, 0)] for d, n in words.items()}
    groups = defaultdict(list)
    for name, members in bins.items():
        members.sort(key=lambda r: r["bin_start"])
        assert [r["bin_start"] for r in members] == [sum(x["length"] for x in members[:i]) for i in range(len(members))]
        used = sum(r["length"] for r in members)
        assert {(r["bin_used"], r["bin_length"]) for r in members} == {(used, min(x for x in packing.LENGTHS if x >= used))}
        groups[name.split(":")[0]] += [r for r in members if r["length"] < most]
    for group, members in groups.items():
        ends, used = plain_best_fit(sorted((r["length"] for r in members), reverse=True), packing.LENGTHS)
        mine = {n: b for n, b in bins.items() if n.split(":")[0] == group and b[0]["length"] < most}
        assert sorted((b[0]["bin_length"], b[0]["bin_used"]) for b in mine.values()) == sorted(zip(ends, used))


def test_derivatives_of_all_pages(spark):
    """Two linked records a page, with the text and links that the library's own parser finds."""
    pages = {r["page_id"]: r for r in table("pages")}
    got = queries.op5_warc(spark, FOLDER).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page, url = pages[r["page_id"]]["html"] or "", pages[r["page_id"]]["url"]
        assert r["error"] is None and r["target_uri"] == url and r["source_payload_digest"] == warc.digest(page.encode())
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        own = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", url), ("WARC-Refers-To", r["refers_to"])]
        own += [("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", r["warc_date"]), ("WARC-Source-Payload-Digest", r["source_payload_digest"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"])]
        record = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own) + f"Content-Length: {r['content_length']}\r\n\r\n{r['block']}\r\n\r\n"
        assert (hashlib.sha256(record.encode()).hexdigest(), len(record.encode())) == (r["record_sha256"], r["record_bytes"])
        plain = Plain(page)
        if r["record_type"] == "conversion":
            assert "".join(r["block"].split()) == "".join("".join(plain.words).split())
        else:
            meta = json.loads(r["block"])
            assert len(meta["HTML-Metadata"]["Links"]) == len(plain.links)
            assert dict(map(tuple, meta["WARC-Header-Metadata"]))["WARC-Record-ID"] == r["refers_to"]


def test_tokens_of_all_documents(spark):
    """sf0.1, which has texts beyond a chunk, so that the overlaps are tried as well."""
    folder = "/root/testdata/sf0.1"
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in queries.op7_token_counts(spark, folder).collect()}
    assert got.keys() == texts.keys() and sum(len(t) > 32_768 for t in texts.values()) >= 5
    chosen = [d for d, t in texts.items() if len(t) > 32_768 or d % 10 == 0]
    for d, found in zip(chosen, tokenizer.encode_batch([texts[d] for d in chosen], add_special_tokens=False)):
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len(texts[d].encode()), len(found), len(found) > 1024)


def test_components_of_all_documents(spark):
    prints = {r["doc_id"]: plain_print(r["text"]) for r in table("documents")}
    label = {d: d for d in prints}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, FOLDER).collect()}
    assert got == {d: (f"{p:016x}", top(d)) for d, p in prints.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql_agree(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    rows = lambda found: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)
    assert rows(got.select(*columns).collect()) == rows(db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
