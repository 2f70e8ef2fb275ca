"""WARC derivatives and TIFF pages: round trips and plain versions."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from tidemark.llm import queries, tiff, warc


def test_strips_tiles_and_predictors_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.uint32):
        for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for predictor in (1, 2):
                for tile in (None, (16, 32)):
                    pages = [rng.integers(0, 9, (rng.integers(1, 50), rng.integers(1, 70), samples)).astype(kind) for samples in (1, 3)]
                    found = list(tiff.pages_of(tiff.write_tiff(pages, [tiff.Layout(compression, predictor, 7, tile)])))
                    assert [p.error for p in found] == [None, None]
                    assert [p.pixels for p in found] == [p.tobytes() for p in pages]


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9000, bytes(range(256)) * 300, bytes(70_000)])
def test_codes_come_back(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_a_known_lzw_stream_and_big_endian_bits():
    # the example of the published format: 7 7 7 8 8 7 7 6 6 as codes 256 7 258 8 8 258 6 6 257
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw_decode(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    entries = [(256, 4, 10), (257, 4, 2), (258, 3, 1 << 16), (259, 3, 1 << 16), (273, 4, 8), (278, 4, 2), (279, 4, 4)]
    body = b"".join(t.to_bytes(2) + k.to_bytes(2) + (1).to_bytes(4) + v.to_bytes(4) for t, k, v in entries)
    file = b"MM\0*" + (12).to_bytes(4) + b"\xff\xc0\x80\x40" + len(entries).to_bytes(2) + body + bytes(4)
    (page,) = tiff.pages_of(file)
    assert (page.width, page.height, page.error) == (10, 2, None)
    assert list(page.pixels) == [1] * 10 + [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_files_that_cannot_be_read(spark):
    good = tiff.write_tiff([np.zeros((3, 4), np.uint8)] * 2, [tiff.Layout()])
    rows = [("good", good), ("none", None), ("empty", b""), ("text", b"hello"), ("cut", good[: len(good) // 2]), ("loop", b"II*\0\x08\0\0\0\0\0\x08\0\0\0"), ("nodir", b"II*\0" + bytes(4))]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "path string, content binary, page int")
    found = {}
    for r in tiff.tiff_pages(df).collect():
        found.setdefault(r["path"], []).append((r["page"], r["pixels"], r["error"] is None))
    assert found["good"] == [(0, bytes(12), True), (1, bytes(12), True)]
    assert all(found[k][0][:2] == (None, None) and not found[k][0][2] for k in ("none", "empty", "text", "nodir"))
    assert not found["loop"][0][2] and all(not ok or p == bytes(12) for _, p, ok in found["cut"])
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def made_tiff(fields, data, big=False, order="<"):
    """A file of one page: data at a fixed place, then the directory; fields are (tag, kind, values) with kinds 3, 4 and 16."""
    size, head = {3: "H", 4: "I", 16: "Q"}, 16 if big else 8
    place, out, later = "Q" if big else "I", bytearray(), bytearray()
    where = head + len(data)
    extra_at = where + (8 + 20 * len(fields) + 8 if big else 2 + 12 * len(fields) + 4)
    for tag, kind, values in sorted(fields):
        raw = struct.pack(f"{order}{len(values)}{size[kind]}", *values)
        out += struct.pack(f"{order}HH{place}", tag, kind, len(values))
        if len(raw) > (8 if big else 4):
            out += struct.pack(order + place, extra_at + len(later))
            later += raw
        else:
            out += raw.ljust(8 if big else 4, b"\0")
    start = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, where) if big else struct.pack(f"{order}HI", 42, where))
    count = struct.pack(order + ("Q" if big else "H"), len(fields))
    return start + data + count + bytes(out) + bytes(8 if big else 4) + bytes(later)


@pytest.mark.parametrize("big, order", [(False, "<"), (True, "<"), (True, ">"), (False, ">")])
def test_planes_bits_and_floats(big, order):
    head = 16 if big else 8
    rng = np.random.default_rng(3)

    def one(height, width, bits, data, sizes, **more):
        places = [head + x for x in np.cumsum([0, *sizes[:-1]]).tolist()]
        fields = {256: (4, [width]), 257: (4, [height]), 258: (3, bits), 259: (3, [1]), 273: (16 if big else 4, places), 277: (3, [len(bits)]), 278: (4, [more.pop("rows", height)]), 279: (4, sizes)}
        fields |= {int(k[1:]): (3, [v]) for k, v in more.items()}
        (page,) = tiff.pages_of(made_tiff([(t, k, v) for t, (k, v) in fields.items()], data, big, order))
        assert page.error is None
        return page.pixels

    planes = rng.integers(0, 256, (3, 4, 5)).astype(np.uint8)  # planar: each sample's strips by themselves, two rows a strip
    assert one(4, 5, [8] * 3, planes.tobytes(), [10] * 6, rows=2, t284=2) == planes.transpose(1, 2, 0).tobytes()
    for bits in (2, 4):
        values = rng.integers(0, 1 << bits, (3, 7))
        rows = ["".join(f"{x:0{bits}b}" for x in r) for r in values.tolist()]
        data = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8)) for r in rows)
        assert one(3, 7, [bits], data, [len(data)]) == values.astype(np.uint8).tobytes()
    numbers = rng.normal(0, 9, (3, 6)).astype("<f4")
    split = numbers.view(np.uint8).reshape(3, 6, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(3, 24)  # highest bytes first
    data = np.concatenate([split[:, :1], np.diff(split, axis=1)], axis=1).tobytes()
    assert one(3, 6, [32], data, [len(data)], t317=3) == numbers.tobytes()


def plain_lzw(data):
    """Codes as text of bits, by the published description."""
    table, bits, word, out = {bytes([i]): i for i in range(256)}, 9, b"", [f"{256:09b}"]
    n = 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        out.append(f"{table[word]:0{bits}b}")
        table[word + bytes([c])] = n
        n, word = n + 1, bytes([c])
        bits = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n == 4094:
            out.append(f"{table[word]:012b}")
            out.append(f"{256:012b}")
            table, bits, word, n = {bytes([i]): i for i in range(256)}, 9, b"", 258
    if word:
        out.append(f"{table[word]:0{bits}b}")
        n += 1
        bits = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    out.append(f"{257:0{bits}b}")
    text = "".join(out)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def test_lzw_of_all_code_widths_against_a_plain_encoder():
    rng = random.Random(8)
    for n in (0, 1, 200, 700, 3000, 20_000):
        data = bytes(rng.choice(b"abcdefgh" if n % 3 else bytes(range(256))) for _ in range(n))
        coded = plain_lzw(data)
        assert tiff.lzw_decode(coded, n) == data and tiff.lzw_encode(data) == coded


def test_headers_that_promise_too_much():
    for bits, samples in ((8, 1), (16, 3)):
        fields = [(256, 4, [1 << 24]), (257, 4, [1 << 24]), (258, 3, [bits] * samples), (259, 3, [8]), (273, 4, [8]), (277, 3, [samples]), (278, 4, [1 << 24]), (279, 4, [5])]
        (page,) = tiff.pages_of(made_tiff(fields, zlib.compress(b"")[:5]))
        assert page.pixels is None and page.error
    (page,) = tiff.pages_of(made_tiff([(256, 4, [2]), (273, 4, [8])], b"x"))
    assert page.pixels is None and page.error
    good = tiff.write_tiff([np.arange(4000, dtype=np.uint8).reshape(50, 80)] * 3, tiff.LAYOUTS)
    rng = random.Random(5)
    for _ in range(3000):  # whatever bytes are damaged, nothing is raised
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.choice([rng.randrange(8), rng.randrange(len(bad))])] = rng.randrange(256)
        assert list(tiff.pages_of(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])))


def plain_feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    spread = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    return -(-n // 65536), n // 64, mean, spread, entropy, len(set(payload))


def test_media_of_all_documents(spark):
    """The registered query over a whole table: lossless, each layout used, features as computed plainly."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op6_tiff(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    used = set()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        if r["doc_id"] % 10 == 0:
            media = tiff.store_payload(payload)
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            pages = list(tiff.pages_of(media))
            used |= {(p.compression, p.tiled) for p in pages}
            assert b"".join(p.pixels for p in pages) == payload
            told = dict(x.split("=") for x in r["feature"].split(";"))
            assert [float(told[k]) for k in ("pages", "rows", "mean", "std", "entropy", "values")] == pytest.approx(plain_feature(payload), abs=1e-5)
    assert len(used) == 8


def test_texts_are_stored_without_loss(spark):
    texts = [None, "", "a" * 64, "é" * 40, "x", "漢字\0" * 30_000, "x"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r["doc_id"]: r for r in tiff.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = tiff.store_payload(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[4][1:] == got[6][1:] and f"pages={-(-len(payload) // 65536)};" in got[6]["feature"]


class Plain(HTMLParser):
    """Visible words and links by the library's own parser."""

    def __init__(self, page):
        super().__init__()
        self.words, self.links, self.hidden = [], [], 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        self.links += [v for k, v in attrs if k in ("href", "src")]

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


PAGE = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <a href="no">x</a> --><h1>One</h1><p>two<br>three &lt;4&gt; é<a class=x href="/five?a=1&amp;b=2">five</a></p><img src=\'pic.png\'></body></html>'


def test_pages_become_text_and_links():
    assert warc.page_text(PAGE) == "One\ntwo\nthree <4> éfive"
    assert [x["url"] for x in warc.page_links(PAGE, "http://h/d/")] == ["http://h/five?a=1&b=2", "http://h/d/pic.png"]


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://h/d/", PAGE, "x"), (2, None, None, "x"), (1, "http://h/d/", PAGE, "x")], "page_id long, url string, html string, record string")
    made = warc.responses(pages)
    source = {r["page_id"]: warc.parse_record(bytes(r["record"]))[0] for r in made.collect()}
    rows = warc.derivatives(made, "page_id").collect()
    assert len(rows) == 6 and {r["record_type"] for r in rows} == {"metadata", "conversion"}
    for r in rows:
        headers = dict(source[r["page_id"]])
        own, block = warc.parse_record(bytes(r["record"]))
        own = dict(own)
        assert own["WARC-Refers-To"] == headers["WARC-Record-ID"] == r["refers_to"]
        assert own["WARC-Source-Payload-Digest"] == headers["WARC-Payload-Digest"] == r["source_payload_digest"]
        assert own.get("WARC-Target-URI") == headers.get("WARC-Target-URI") and own["WARC-Date"] == headers["WARC-Date"]
        assert own["WARC-Block-Digest"] == warc.digest(block) and block.decode() == r["block"]
        if r["record_type"] == "metadata":
            meta = json.loads(r["block"])
            assert dict(map(tuple, meta["WARC-Header-Metadata"]))["WARC-Record-ID"] == headers["WARC-Record-ID"]
            assert meta["HTTP-Response-Metadata"]["Status"] == "HTTP/1.1 200 OK"
            assert meta["HTML-Metadata"]["Title"] == ("A & B" if r["page_id"] == 1 else None)
    assert len({r["record_id"] for r in rows}) == 4


def test_given_pages_against_the_parser(spark):
    for page, url in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", "url").limit(60).toPandas().itertuples(index=False):
        plain = Plain(page)
        assert "".join(warc.page_text(page).split()) == "".join("".join(plain.words).split())
        assert len(warc.page_links(page, url)) == len(plain.links)


def test_records_that_are_no_responses(spark):
    request = warc.build_record([("WARC-Type", "request")], b"GET / HTTP/1.1\r\n\r\n")
    cut = warc.build_record([("WARC-Type", "response")], b"x" * 100)[:-60]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([request, cut, b"", None, b"junk\r\n\r\n"])], "record_key long, record binary")
    rows = warc.derivatives(df).collect()
    assert len(rows) == 5 and all(r["record_type"] is None and r["error"] for r in rows)
    assert warc.derivatives(df.limit(0)).count() == 0


def test_files_of_records_and_coded_bodies(spark, tmp_path):
    body = zlib.compressobj(wbits=31)
    coded = body.compress(b"<p>hi</p>") + body.flush()
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(coded), coded)
    http = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-Long: a\r\n b\r\n\r\n" + chunked
    records = [warc.build_record([("WARC-Type", "warcinfo")], b"software: x\r\n"), warc.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], http)]
    members = b""
    for r in records:
        z = zlib.compressobj(wbits=31)
        members += z.compress(r) + z.flush()
    (tmp_path / "a.warc.gz").write_bytes(members)
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    found = warc.read_warc(spark, f"file://{tmp_path}")
    assert sorted(r["position"] for r in found.collect()) == [0, 0, 1, 1]
    texts = [r["block"] for r in warc.derivatives(found.filter("position = 1"), "position").filter("record_type = 'conversion'").collect()]
    assert texts == ["hi", "hi"]
    assert {r["error"] for r in found.collect()} == {None}


def test_damaged_files_and_charsets(spark, tmp_path):
    good = warc.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], b"HTTP/1.1 200 OK\r\n\r\nhi")
    z = zlib.compressobj(wbits=31)
    member = z.compress(good * 40) + z.flush()
    cases = {
        "cut": good * 2 + good[:-10], "nolength": good + b"WARC/1.1\r\n\r\nx", "length": good + b"WARC/1.1\r\nContent-Length: -5\r\n\r\n", "junk": b"\0" * 3_000_000,
        "gzcut": member + member[:-30], "gzbad": member + b"\x1f\x8b" + b"\xff" * 60, "gztail": member + b"tail", "empty": b"", "only": b"\r\n\r\n",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {}
    for r in warc.read_warc(spark, f"file://{tmp_path}").collect():
        found.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["position"], r["record"] is None, r["error"] is None))
    good_rows = {"cut": 2, "nolength": 1, "length": 1, "junk": 0, "gzcut": 40, "gzbad": 40, "gztail": 40}
    for name, n in good_rows.items():
        rows = sorted(found[name])
        assert rows[-1] == (len(rows) - 1, True, False) and all(r[1:] == (False, True) for r in rows[:-1]) and len(rows) > n, name
    assert "empty" not in found and "only" not in found
    for charset in ("idna", "undefined", "none-such", "base64", "utf-16", "punycode", "unicode_escape"):
        record = warc.build_record([("WARC-Type", "response")], f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>\x00..a\\x</p>".encode())
        assert [r[0] for r in warc.derive(record)] == ["metadata", "conversion"]
    for coding in ("gzip", "deflate"):
        for body in (b"\x1f\x8b damaged", member[:40], b"plain", b""):
            assert len(warc.derive(warc.build_record([("WARC-Type", "response")], f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n\r\n".encode() + body))) == 2
