"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both refer to the response by WARC-Refers-To, its target URI and its date, and keep its
payload digest. The metadata record's block is JSON with all WARC and HTTP headers of
the source in their order, its title and its links; the conversion record's block is
the page's text. Record ids follow from the response's id and the kind of record, so that
reruns agree and derivatives can be matched.

A null, empty or unreadable record, one that is not a response, and one whose body unpacks to more than
LARGEST bytes gives one row with a null record_type and the reason in `error`. A damaged or cut file gives its records up to the
damage and one row with a null record and the reason. A response without a record id or a digest
has null there, and its payload's digest is computed. Repeated rows repeat their results.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "WARC/1.1"
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(headers: Headers, block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> tuple[str, Headers]:
    """First line and fields; a line that begins with white space continues the field before it."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    found: Headers = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return lines[0].strip(), found


def _get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _ends(data: bytes | bytearray) -> tuple[bytes, int] | None:
    """A header block, and where its body begins."""
    ends = [(e, n) for e, n in ((data.find(b"\r\n\r\n"), 4), (data.find(b"\n\n"), 2)) if e >= 0]
    return (bytes(data[: min(ends)[0]]), sum(min(ends))) if ends else None


def _cut(data: bytes) -> tuple[bytes, int]:
    found = _ends(data)
    if found is None:
        raise ValueError("headers do not end")
    return found


#: Bytes that a step of unpacking takes in and gives out, and that a record's headers may have.
PIECE, LONGEST_HEAD = 1 << 18, 1 << 20
#: Bytes that a body may unpack to.
LARGEST = 1 << 28


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, or the data itself, piece by piece."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + PIECE] for at in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            fresh = b"" if member.unconsumed_tail else data[at : at + PIECE]
            at += len(fresh)
            piece = member.decompress(member.unconsumed_tail or fresh, PIECE)
            if not piece and not fresh and not member.eof:
                raise ValueError("a gzip member is cut short")
            yield piece
        at -= len(member.unused_data)


def bounded(pieces: Iterator[bytes]) -> bytes:
    """The pieces joined; more than LARGEST bytes are an error, and are not held."""
    out = bytearray()
    for piece in pieces:
        out += piece
        if len(out) > LARGEST:
            raise TooLarge(f"the body unpacks to more than {LARGEST} bytes")
    return bytes(out)


class TooLarge(Exception):
    pass


def gunzipped(data: bytes) -> bytes:
    """All members of a gzip file, or the data itself."""
    return bounded(_unpacked(data))


def inflated(data: bytes) -> bytes:
    """A zlib stream."""
    member = zlib.decompressobj()

    def pieces() -> Iterator[bytes]:
        rest = data
        while not member.eof:
            piece = member.decompress(rest, PIECE)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("a zlib stream is cut short")
            rest = member.unconsumed_tail
            yield piece

    return bounded(pieces())


def split_records(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The records of a WARC file, plain or gzipped, one at a time; at the end the reason, if the rest can't be read."""
    held, pieces = bytearray(), _unpacked(data)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    try:
        while True:
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
            if not held:
                if more():
                    continue
                return
            while (found := _ends(held)) is None:
                if len(held) > LONGEST_HEAD or not more():
                    raise ValueError("headers do not end")
            head, body = found
            length = _get(_headers(head)[1], "Content-Length") or ""
            if not (length.isascii() and length.isdigit()):
                raise ValueError("a record without a length")
            end = body + int(length)
            while len(held) < end:
                if not more():
                    raise ValueError("the last record is cut short")
            yield bytes(held[:end]), None
            del held[:end]
    except (ValueError, zlib.error) as e:
        yield None, f"{type(e).__name__}: {e}"


def parse_record(record: bytes) -> tuple[Headers, bytes]:
    head, body = _cut(record)
    version, headers = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    length = _get(headers, "Content-Length")
    if length is None or not length.isdigit() or body + int(length) > len(record):
        raise ValueError("the block is cut short")
    return headers, record[body : body + int(length)]


# Elements whose content isn't text, those that end a line, and those that hold links.
DROPPED = ("script", "style", "template", "noscript", "svg", "title")
BLOCKS = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre "
    "section select table tbody td tfoot th thead tr ul"
).split()
LINKS = ("a", "area", "link", "img", "script", "iframe", "source", "embed")

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in DROPPED}
_REFERENCE = re.compile(r"\s(?:href|src)\s*=\s*", re.I)
_BARE = re.compile(r"""[^\s>"']+""")
_NUMBER = re.compile(r"&#(?:(?=[0-9])0*([0-9]*)|[xX](?=[0-9a-fA-F])0*([0-9a-fA-F]*));?")


def _short(m: re.Match) -> str:
    """A numeric reference without needless zeros; the replacement character for a number beyond all characters."""
    digits, hexadecimal = m[1], m[2]
    if len(digits or "") > 7 or len(hexadecimal or "") > 6:
        return "\ufffd"
    return f"&#{digits or 0};" if hexadecimal is None else f"&#x{hexadecimal or 0};"


def unescaped(text: str) -> str:
    """Character references as characters, however long their numbers are."""
    return html.unescape(_NUMBER.sub(_short, text))


def tags(page: str, skip: bool) -> Iterator[tuple[int, int, str, bool]]:
    """Places [start, end) of tags and comments with their name ("" for others than elements) and whether it is an end tag, from left to right.

    A tag goes to the next `>`. Each place is looked at once. skip: what stands inside elements of DROPPED is passed over, and the
    place of such an element includes it.
    """
    at = 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False
            continue
        following = page[start + 1 : start + 2]
        if not (following and following in "/!?" or following.isascii() and following.isalpha()):
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:  # nothing that follows is a tag either, but comments are
            start = page.find("<!--", start)
            if start < 0:
                return
            at = start
            continue
        at = end + 1
        named = _NAME.match(page, start, end)
        name, closing = named[1].lower() if named else "", following == "/"
        if skip and name in _CLOSE and not closing:
            found = _CLOSE[name].search(page, at)
            at = found.end() if found else len(page)
        yield start, at, name, closing


def page_text(page: str) -> str:
    """Visible text: a line per block, without white space at its ends or in rows."""
    out, at = [], 0
    for start, end, name, closing in tags(page, skip=True):
        out.append(page[at:start])
        out.append(" " if page.startswith("<!--", start) or (name in _CLOSE and not closing) else "\n" if name in BLOCKS else "")
        at = end
    out.append(page[at:])
    lines = (" ".join(line.split()) for line in unescaped("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def page_title(page: str) -> str | None:
    for start, end, name, closing in tags(page, skip=True):
        if name == "title" and not closing:
            text = page[page.find(">", start) + 1 : end]
            close = [m.start() for m in _CLOSE[name].finditer(text)]
            return " ".join(unescaped(text[: close[0]] if close else text).split())
    return None


def page_links(page: str, base: str) -> list[dict[str, str]]:
    """Tag and absolute address of each link outside comments; one that can't be resolved stays as it is."""
    found, after = [], 0
    ends: dict[str, bool] = {}  # quotes that don't come again
    for start, end, name, closing in tags(page, skip=False):
        if start < after or closing or name not in LINKS:
            continue
        # an element's own attribute, whose value may hold a `>`
        if (named := _REFERENCE.search(page, start, end)) is None:
            continue
        at = named.end()
        quote = page[at : at + 1]
        if quote in ('"', "'"):
            stop = -1 if quote in ends else page.find(quote, at + 1)
            if stop < 0:
                ends[quote] = True
                continue
            value, after = page[at + 1 : stop], stop
        elif bare := _BARE.match(page, at):
            value = bare[0]
        else:
            continue
        url = unescaped(value).strip()
        try:
            url = urljoin(base, url)
        except ValueError:
            pass
        found.append({"path": f"{name.upper()}@/{'href' if name in ('a', 'area', 'link') else 'src'}", "url": url})
    return found


_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*\Z")


def _body(http: Headers, payload: bytes) -> bytes:
    """The payload without its transfer and content coding; as it is where these can't be undone."""
    if (_get(http, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = _CHUNK.match(payload[at:end].split(b";")[0]) if end - at < 4096 else None
            if size is None:
                break
            n = int(size[1], 16)
            if not n:
                payload = b"".join(out)
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 4 + n
    coding = (_get(http, "Content-Encoding") or "").lower()
    try:
        return gunzipped(payload) if coding == "gzip" else inflated(payload) if coding == "deflate" else payload
    except (ValueError, zlib.error):
        return payload


def _decoded(http: Headers, body: bytes) -> str:
    named = re.search(r"charset\s*=\s*[\"']?([\w-]+)", _get(http, "Content-Type") or "", re.I) or re.search(r"charset\s*=\s*[\"']?([\w-]+)", body[:1024].decode("ascii", "replace"), re.I)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no such charset, or one that can't stand in for what it can't decode
        return body.decode("utf-8", "replace")


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id} {kind}')}>"


_OUT = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, "
    "source_payload_digest string, content_length long, block string, record binary, error string"
)


def derive(record: bytes | None) -> list[tuple]:
    """Rows of _OUT for one record."""
    try:
        headers, block = parse_record(record or b"")
        if (kind := _get(headers, "WARC-Type")) != "response":
            raise ValueError(f"a record of type {kind}, not a response")
        head, at = _cut(block)
    except ValueError as e:
        return [(None,) * 11 + (str(e),)]
    status, http = _headers(head)
    payload = block[at:]
    source, uri, date = (_get(headers, f"WARC-{x}") for x in ("Record-ID", "Target-URI", "Date"))
    sha1 = _get(headers, "WARC-Payload-Digest") or digest(payload)
    try:
        page = _decoded(http, _body(http, payload))
    except TooLarge as e:
        return [(None,) * 11 + (str(e),)]
    meta = {
        "WARC-Header-Metadata": headers,
        "HTTP-Response-Metadata": {"Status": status, "Headers": http, "Entity-Length": len(payload), "Entity-Digest": digest(payload)},
        "HTML-Metadata": {"Title": page_title(page), "Links": page_links(page, uri or "")},
    }
    made = []
    for kind, mime, text in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", page_text(page))):
        data = text.encode("utf-8", "replace")
        own = derived_id(source or sha1, kind)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        fields += [("WARC-Source-Payload-Digest", sha1), ("WARC-Block-Digest", digest(data)), ("Content-Type", mime)]
        written = build_record([(k, v) for k, v in fields if v is not None], data)
        made.append((kind, own, source, uri, date, mime, digest(data), sha1, len(data), data.decode(), written, None))
    return made


def derivatives(records: DataFrame, id_col: str = "record_key", record_col: str = "record") -> DataFrame:
    """Metadata and conversion rows of each response in record_col, with its id."""
    given = records.select(F.col(f"`{id_col}`"), F.col(f"`{record_col}`").alias("__record"))
    schema = T.StructType([given.schema[0], *T.StructType.fromDDL(_OUT).fields])
    arrow = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, r) for i, record in enumerate(part.column(1)) for r in derive(record.as_py())]
                ids = part.column(0).take(pa.array([i for i, _ in rows]))
                columns = zip(*[r for _, r in rows], strict=True)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]], schema.names)

    return given.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: path, position in the file, record, error. A file is held as it is stored, and unpacked record by record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, (record, error) in enumerate(split_records(content.as_py())):
                    columns = [pa.array([name]), pa.array([n], pa.int64()), pa.array([record], pa.binary()), pa.array([error], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "position", "record", "error"])

    return files.mapInArrow(run, "path string, position long, record binary, error string")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as WARC response records: their id and record. Null html counts as empty; a null url has no target URI."""
    given = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("__html"))
    schema = T.StructType([given.schema[0], T.StructField("record", T.BinaryType())])

    def one(key: object, url: str | None, page: str | None) -> bytes:
        body = (page or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>"), ("WARC-Date", date), ("WARC-Target-URI", url)]
        fields += [("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
        return build_record([(k, " ".join(v.split())) for k, v in fields if v is not None], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [one(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], schema.names)

    return given.mapInArrow(run, schema)
