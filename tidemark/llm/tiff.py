"""TIFF media columns: files to one row per page, and lossless storage of payloads as pages.

The reader walks the chain of image directories of a classic or big TIFF of either byte
order, decodes strips or tiles that are plain, PackBits, LZW or deflate, undoes the
horizontal and the floating-point predictor, and gives each page's samples as bytes
(row by row, pixel by pixel, samples in native little-endian order).

Null or empty content, files that can't be read and those without a directory give one row with page null and the
reason in `error`; a page that can't be read gives its row with null pixels. Repeated
rows give repeated pages. A page whose header promises more than its stored bytes can hold is
not decoded, so that memory is bounded by them. Pages are held one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

# TIFF's tags, compressions and sizes of field types.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that a stored byte can give at most, by compression.
_MOST = {PLAIN: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: Samples a row, rows a page and rows a strip of a stored payload.
ROW, PAGE_ROWS, STRIP_ROWS = 64, 1024, 256


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes | None
    error: str | None = None


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as repeats, all else as literals of 128 at most."""
    held = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(held)))
    long = size >= 3
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            out.append(min(end - k, 128) - 1)
            out.extend(data[k : min(end, k + 128)])

    for start, n in zip(edge[long].tolist(), size[long].tolist(), strict=True):
        literal(start)
        for k in range(0, n, 128):
            part = min(n - k, 128)
            out += bytes([257 - part if part > 1 else 0, data[start]])
        at = start + n
    literal(len(data))
    return bytes(out)


#: LZW codes that clear the table and that end the data; a table is cleared before it has 4,094 codes.
_CLEAR, _END, _FULL = 256, 257, 4094
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]
#: Widths of the codes after a clear code: code k adds the entry 257 + k, and the width grows one code early.
_WIDTHS = np.array([9 if k <= 254 else 10 if k <= 766 else 11 if k <= 1790 else 12 for k in range(1, 4096)])
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, all of a table read at once: their widths follow from their number."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    out: list[bytes] = []
    held, at, bits = 0, 0, 8 * len(data)
    while held < size:
        n = int(np.searchsorted(_STARTS, bits - at, "right")) - 1
        if n < 1:
            break
        place, width = at + _STARTS[:n], _WIDTHS[:n]
        codes = (words[place >> 3] >> (32 - width - (place & 7)).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == _CLEAR) | (codes == _END))
        last = int(stop[0]) if len(stop) else n
        table, before = list(_SINGLE), None
        for code in codes[:last].tolist():
            if before is None:
                word = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code out of range")
                word = table[code] if code < len(table) else before + before[:1]
                table.append(before + word[:1])
            out.append(word)
            held += len(word)
            if held >= size:
                break
            before = word
        if last == n or codes[last] == _END:
            break
        at += int(_STARTS[last + 1])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [_CLEAR], [9]
    at = 0
    while at < len(data):
        table: dict[int, int] = {}  # by a code and the byte after it
        word, n, k = data[at], 258, at + 1
        first = len(codes)
        for k in range(at + 1, len(data)):
            key = (word << 8) | data[k]
            longer = table.get(key)
            if longer is None:
                codes.append(word)
                table[key] = n
                n += 1
                word = data[k]
                if n == _FULL:
                    break
            else:
                word = longer
        codes.append(word)
        at = len(data) if n < _FULL else k + 1
        codes.append(_CLEAR if n == _FULL else _END)
        widths.append(_WIDTHS[: len(codes) - first])
    if len(codes) == 1:
        codes.append(_END)
        widths.append(np.array([9]))
    width = np.concatenate([np.atleast_1d(w) for w in widths])
    if codes[-1] == _CLEAR:  # the data ends with a full table
        codes.append(_END)
        width = np.append(width, 9)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def _decoded(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size) if size else b""
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    raise ValueError(f"compression {compression} is not supported")


def _encoded(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def _samples(data: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """A strip's or tile's samples as bytes: rows x columns x (bytes of a pixel)."""
    if bits in (1, 2, 4):
        wide = -(-columns * samples * bits // 8)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, rows * wide).reshape(rows, wide), axis=1)
        flat = flat[:, : columns * samples * bits].reshape(rows, columns * samples, bits)
        return (flat @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8).reshape(rows, columns, samples)
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    size = bits // 8
    if predictor == 3:  # bytes of all samples by significance, highest first, differenced
        planes = np.frombuffer(data, np.uint8, rows * columns * samples * size).reshape(rows, -1, samples)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return planes[:, ::-1].transpose(0, 2, 1).reshape(rows, columns, samples * size)
    found = np.frombuffer(data, f"{order}u{size}", rows * columns * samples).reshape(rows, columns, samples).astype(f"<u{size}")
    if predictor == 2:
        found = np.add.accumulate(found, axis=1, dtype=found.dtype)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return np.ascontiguousarray(found).view(np.uint8).reshape(rows, columns, samples * size)


def directories(content: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and the fields by tag of each image directory. A directory that comes again ends the chain."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(f"{order}H", content, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    count, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    room = 8 if big else 4
    at = struct.unpack_from(order + place, content, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, content, at)[0]
        start = at + struct.calcsize(order + count)
        fields = {}
        for k in range(n):
            here = start + k * entry
            tag, kind = struct.unpack_from(f"{order}HH", content, here)
            number = struct.unpack_from(order + place, content, here + 4)[0]
            here += 4 + struct.calcsize(order + place)
            if kind not in _TYPES:
                continue
            if number > len(content):
                raise ValueError("a field is longer than the file")
            if struct.calcsize(f"={_TYPES[kind]}") * number > room:
                here = struct.unpack_from(order + place, content, here)[0]
            fields[tag] = struct.unpack_from(f"{order}{number}{_TYPES[kind]}", content, here)
        yield order, fields
        at = struct.unpack_from(order + place, content, start + n * entry)[0]


def _whole(fields: dict[int, tuple], tag: int) -> tuple[int, ...]:
    """A tag's values, which must be whole numbers that fit into 31 bits."""
    values = fields[tag]
    if not values or not all(isinstance(v, int) and 0 <= v < 1 << 31 for v in values):
        raise ValueError(f"tag {tag} has no usable value")
    return values


def _rows_per_strip(fields: dict[int, tuple], height: int) -> int:
    """At most the height; the largest number there is stands for a page of one strip."""
    values = fields.get(ROWS_PER_STRIP, (height,))
    if not values or not isinstance(values[0], int):
        raise ValueError(f"tag {ROWS_PER_STRIP} has no usable value")
    return min(values[0], height)


def _page(number: int, content: bytes, order: str, fields: dict[int, tuple]) -> Page:
    one = lambda tag, default: _whole(fields, tag)[0] if tag in fields else default
    page = Page(number, 0, 0, 0, 0, 0, 0, TILE_OFFSETS in fields, None)
    try:
        width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
        page = Page(number, width, height, samples, bits, one(COMPRESSION, PLAIN), one(PREDICTOR, 1), TILE_OFFSETS in fields, None)
        if len(set(fields.get(BITS, (bits,)))) > 1 or one(FILL_ORDER, 1) != 1:
            raise ValueError("mixed sample sizes or reversed bits are not supported")
        planes = samples if one(PLANAR, 1) == 2 else 1
        each = samples // planes
        if page.tiled:
            columns, rows, places, sizes = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), _whole(fields, TILE_OFFSETS), _whole(fields, TILE_COUNTS)
        else:
            columns, rows, places, sizes = width, _rows_per_strip(fields, height), _whole(fields, STRIP_OFFSETS), _whole(fields, STRIP_COUNTS)
        pixel = each * max(1, bits // 8)
        across = -(-width // columns)
        down = -(-height // rows)
        if across * down * planes > min(len(places), len(sizes)):
            raise ValueError("strips or tiles are missing")
        stored = sum(len(content[p : p + n]) for p, n in zip(places, sizes, strict=False))
        if height * width * samples * bits > 8 * stored * _MOST.get(page.compression, 1):
            raise ValueError("the header promises more than the data can hold")
        out = np.zeros((height, width, planes, pixel), np.uint8)
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            top, left = cell // across * rows, cell % across * columns
            high = rows if page.tiled else min(rows, height - top)
            want = high * -(-columns * each * bits // 8)
            data = _decoded(content[places[k] : places[k] + sizes[k]], page.compression, want)
            if len(data) < want:
                raise ValueError("a strip or tile is cut short")
            part = _samples(data, high, columns, each, bits, page.predictor, order)
            out[top : top + high, left : left + columns, plane] = part[: height - top, : width - left]
        page.pixels = out.tobytes()
    except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, TypeError, struct.error, zlib.error) as e:
        page.error = f"{type(e).__name__}: {e}"
    return page


def pages_of(content: bytes | None) -> Iterator[Page]:
    """Each page of a file, in the order of its directories."""
    number = 0
    try:
        for order, fields in directories(content or b""):
            yield _page(number, content, order, fields)
            number += 1
        if not number:
            raise ValueError("no image directory")
    except (ValueError, OverflowError, MemoryError, IndexError, struct.error) as e:
        yield Page(-1, 0, 0, 0, 0, 0, 0, False, None, f"{type(e).__name__}: {e}")


@dataclass(frozen=True)
class Layout:
    """How a page is stored: in strips of so many rows, or in tiles (length, width)."""

    compression: int = DEFLATE
    predictor: int = 2
    rows: int = STRIP_ROWS
    tile: tuple[int, int] | None = None


def write_tiff(pages: list[np.ndarray], layouts: list[Layout]) -> bytes:
    """Pages (height x width x samples, unsigned) as a little-endian TIFF; page i has the layout i, counted around."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for number, page in enumerate(pages):
        layout = layouts[number % len(layouts)]
        compression, predictor, tile = layout.compression, layout.predictor, layout.tile
        page = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = page.shape
        high, wide = tile or (layout.rows, width)
        places, sizes = [], []
        for top in range(0, height, high):
            for left in range(0, width, wide):
                part = page[top : top + high, left : left + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                data = _encoded(np.ascontiguousarray(part).tobytes(), compression)
                places.append(len(out))
                sizes.append(len(data))
                out += data
        bits = page.dtype.itemsize * 8
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1])]
        if tile:
            fields += [(SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [wide]), (TILE_LENGTH, 4, [high]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, places), (SAMPLES, 3, [samples]), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, sizes), (PREDICTOR, 3, [predictor])]
        entries = bytearray()
        for tag, kind, values in fields:
            data = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, place = struct.pack("<I", len(out)), data
                out += place
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Layouts that the pages of stored payloads go around.
LAYOUTS = [Layout(c, p, tile=t) for t in (None, (256, 32)) for c, p in ((DEFLATE, 2), (LZW, 1), (PACKBITS, 1), (PLAIN, 1))]


def store_payload(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as 8-bit pages of 64 samples a row. The first page's layout follows from the payload's CRC-32."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    first = zlib.crc32(payload) % len(LAYOUTS)
    return write_tiff([rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)], LAYOUTS[first:] + LAYOUTS[:first])


_PAGE_FIELDS = "page int, width long, height long, samples long, bits long, compression long, predictor long, tiled boolean, pixels binary, error string"


def tiff_pages(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per page of each file: its id, and the page's header, pixels and error."""
    given = files.select(F.col(f"`{id_col}`"), F.col(f"`{content_col}`").alias("__content"))
    schema = T.StructType([given.schema[0], *T.StructType.fromDDL(_PAGE_FIELDS).fields])
    arrow = [pa.int32(), pa.int64(), pa.int64()] + [pa.int64()] * 4 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for p in pages_of(batch.column(1)[row].as_py()):
                    made = (None if p.number < 0 else p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, p.error)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *[pa.array([c], t) for c, t in zip(made, arrow, strict=True)]], schema.names)

    return given.mapInArrow(run, schema)


def features(pages: list[Page]) -> str:
    """Pages, rows, mean and deviation of the samples, entropy and used values of a payload's pages."""
    counts = sum(np.bincount(np.frombuffer(p.pixels, np.uint8), minlength=256) for p in pages)
    values, total = np.arange(256), int(counts.sum())
    mean = int(counts @ values) / total
    spread = max(0.0, int(counts @ values**2) / total - mean * mean) ** 0.5
    share = counts[counts > 0] / total
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};mean={mean:.6f};std={spread:.6f};entropy={-float((share * np.log2(share)).sum()):.6f};values={len(share)}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as a TIFF, reads its pages back and describes them."""
    fields = T.StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        rows = []
        for text in texts:
            raw = (text or "").encode()
            media = store_payload(raw + b"\0" * ((-len(raw)) % ROW or (ROW if not raw else 0)))
            pages = list(pages_of(media))
            if bad := [p.error for p in pages if p.error]:
                raise ValueError(bad[0])
            back = b"".join(p.pixels for p in pages)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)))
        return dict(zip(fields.names, map(pa.array, zip(*rows, strict=True)), strict=True))

    return map_texts(docs, [id_col], text_col, fields, run)
