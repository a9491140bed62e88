"""TIFF media columns: a reader of whole image directories and a writer for payloads.

The reader walks the chain of image directories, decodes PackBits, LZW or
deflate strips and tiles, undoes horizontal differencing and gives one row per
page. The writer stores samples in any of these forms.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents

# Fixed values of the format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}
_CLEAR, _END = 256, 257


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, most: int) -> bytes:
    """The bytes that data stands for; decoding stops once there are over most. So do the other decoders."""
    out, at, size = [], 0, 0
    while at < len(data) and size <= most:
        n = data[at]
        size += n + 1 if n < 128 else 257 - n if n > 128 else 0
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 1 + (n > 128)
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more alike as repeats, all else as literals."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    edges = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1], [True]]))
    out, literal = [], 0

    def literals(until: int):
        for a in range(literal, until, 128):
            part = data[a : min(a + 128, until)]
            out.append(bytes([len(part) - 1]) + part)

    long_runs = np.flatnonzero(np.diff(edges) >= 3)
    for a, b in zip(edges[long_runs].tolist(), edges[long_runs + 1].tolist(), strict=True):
        literals(a)
        while b - a >= 2:
            n = min(128, b - a)
            out.append(bytes([257 - n, data[a]]))
            a += n
        literal = a
    literals(len(data))
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    stream = zlib.decompressobj()
    out = stream.decompress(data, most + 1)
    if len(out) <= most and not stream.eof:
        raise ValueError("a deflate stream ends early")
    return out


def lzw_decode(data: bytes, most: int) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, total, before, width, held, bits = [], 0, None, 9, 0, 0
    for byte in data:
        if total > most:
            break
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            del table[258:]
            before, width = None, 9
            continue
        if before is None:
            if code > 255:
                raise ValueError("an LZW code comes before its entry")
            found = table[code]
        elif code > len(table) or len(table) > 4095:
            raise ValueError("an LZW code comes before its entry")
        else:
            found = table[code] if code < len(table) else before + before[:1]
            table.append(before + found[:1])
        out.append(found)
        total += len(found)
        before = found
        size = len(table) + 1  # codes grow one entry early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(_CLEAR, 9)
    table, size, width, seen = {bytes([i]): i for i in range(256)}, 258, 9, b""
    for i in range(len(data)):
        longer = seen + data[i : i + 1]
        if longer in table:
            seen = longer
            continue
        put(table[seen], width)
        table[longer] = size
        size += 1
        if size == 4094:
            put(_CLEAR, width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        seen = data[i : i + 1]
    if seen:
        put(table[seen], width)
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(_END, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


_UNPACK = {NONE: lambda data, most: data, LZW: lzw_decode, DEFLATE: inflate, DEFLATE_OLD: inflate, PACKBITS: unpack_bits}
#: Bytes of a page's samples, at most; larger pages are errors.
LARGEST = 1 << 29
#: Bytes of pages that one batch of rows holds before it is passed on.
HELD = 1 << 25
#: How many bytes one compressed byte can stand for at most.
_GROWTH = {NONE: 1, LZW: 2731, DEFLATE: 1032, DEFLATE_OLD: 1032, PACKBITS: 64}
_PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: pack_bits}


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of 8- or 16-bit samples, height x width or height x width x samples; tile: its (width, height)."""
    body, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for pixels in pages:
        pixels = pixels.reshape(*pixels.shape[:2], -1)
        height, width, samples = pixels.shape
        kind = pixels.dtype.newbyteorder("<")
        step = tile or (width, rows_per_strip)
        offsets, counts = [], []
        for y in range(0, height, step[1]):
            for x in range(0, width, step[0]):
                part = pixels[y : y + step[1], x : x + step[0]]
                if tile:
                    part = np.pad(part, ((0, step[1] - part.shape[0]), (0, step[0] - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = _PACK[compression](part.astype(kind).tobytes())
                offsets.append(len(body))
                counts.append(len(data))
                body += data + b"\0" * (len(data) % 2)
        tags: dict[int, tuple[int, list[int]]] = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * pixels.itemsize] * samples), COMPRESSION: (3, [compression]),
            PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]),
        }
        if tile:
            tags |= {TILE_WIDTH: (4, [step[0]]), TILE_HEIGHT: (4, [step[1]]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [step[1]]), STRIP_COUNTS: (4, counts)}
        entries = b""
        for tag, (code, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{FIELD[code]}", *values)
            if len(raw) > 4:
                at = len(body)
                body += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", body, links[-1], len(body))
        links.append(len(body) + 2 + len(entries))
        body += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(body)


def read(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in either byte order; ValueError where it can't be read."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a link leads astray")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, code, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if code in FIELD:
                form = f"{order}{count}{FIELD[code]}"
                place = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = list(struct.unpack_from(form, data, place))
        yield _page(data, tags, order)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or compression not in _UNPACK or predictor not in (1, 2) or one(PLANAR, 1) != 1:
        raise ValueError(f"{bits} bits, compression {compression}, predictor {predictor}: not supported")
    tiled = TILE_OFFSETS in tags
    step = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    kind = np.dtype(f"{order}u{bits // 8}")
    if min(width, height, samples, *step) < 1:
        raise ValueError("a page or its parts have no size")
    if -(-height // step[1]) * -(-width // step[0]) > min(len(offsets), len(counts)):
        raise ValueError("parts of the page are missing")
    if width * height * samples * kind.itemsize > LARGEST or step[0] * step[1] * samples * kind.itemsize > LARGEST:
        raise ValueError("a page is too large")
    if width * height * samples * kind.itemsize > _GROWTH[compression] * sum(counts) or sum(counts) > len(data) * len(counts):
        raise ValueError("the data can't hold so many pixels")
    pixels, part = None, 0
    for y in range(0, height, max(1, step[1])):
        for x in range(0, width, max(1, step[0])):
            rows = step[1] if tiled else min(step[1], height - y)
            wanted = rows * step[0] * samples * kind.itemsize
            raw = _UNPACK[compression](data[offsets[part] : offsets[part] + counts[part]], wanted)
            if len(raw) != wanted:
                raise ValueError("a part holds another number of bytes than its pixels take")
            if pixels is None:  # not before a part was decoded
                pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
            block = np.frombuffer(raw, kind).reshape(rows, step[0], samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=pixels.dtype)
            pixels[y : y + rows, x : x + step[0]] = block[: height - y, : width - x]
            part += 1
    return Page(width, height, samples, bits, NAMES[compression], predictor, tiled, pixels)


def feature(page: Page) -> str:
    """A page's layout, mean, deviation and entropy of its samples, and mean step between neighbours."""
    flat = page.pixels.reshape(-1)
    share = np.bincount(flat.view(np.uint8) if flat.itemsize > 1 else flat, minlength=256) / max(1, flat.nbytes)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    level = np.arange(256)
    mean = (share * level).sum()
    deviation = np.sqrt(max(0.0, (share * level * level).sum() - mean * mean))
    steps = np.abs(np.diff(flat.astype(np.int32))).mean() if flat.size > 1 else 0.0
    return f"{page.width}x{page.height}x{page.samples}:{page.bits}:{page.compression}:{page.predictor}:mean={mean:.4f}:sd={deviation:.4f}:entropy={entropy:.4f}:step={steps:.4f}"


def tiff_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each row's TIFF: media's columns, then page, width, height, samples, bits, compression, predictor, tiled, pixels, feature, error.

    pixels are the page's samples in reading order, 16-bit ones little-endian.
    A part that decodes to more or fewer bytes than its pixels take, and a page of more
    than LARGEST bytes, are errors; decoding stops as soon as a part is too long.
    Null media, and media that can't be read to the end, give one row whose page
    and pixels are null and whose error says why, after the pages read so far.
    Each row stands alone, so repeated rows and null ids stay as they are.
    Columns of media that share a name with a new one must be renamed before.
    """
    new = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, feature string, error string"
    clash = {x.split(" ")[0] for x in new.split(", ")} & set(media.columns)
    if clash:
        raise ValueError(f"rename first: {sorted(clash)}")

    kinds = (pa.int32(),) * 5 + (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.string())

    def values(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("null")
            for n, p in enumerate(read(data)):
                yield n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), feature(p), None
        except (ValueError, KeyError, IndexError, MemoryError, OverflowError, struct.error, zlib.error) as e:
            yield *[None] * 10, str(e)

    def run(batches):
        for big in batches:
            for batch in slices(big, 64):
                rows, made, held = [], [], 0

                def put(rows, made, batch=batch):
                    kept = batch.take(pa.array(rows, pa.int64()))
                    columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                    return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*batch.schema.names, *(x.split(" ")[0] for x in new.split(", "))])

                for i, data in enumerate(batch.column(media_col).to_pylist()):
                    for page in values(data):
                        rows.append(i)
                        made.append(page)
                        held += len(page[8] or b"")
                        if held > HELD:
                            yield put(rows, made)
                            rows, made, held = [], [], 0
                if rows:
                    yield put(rows, made)

    return media.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema) + ", " + new)


def as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 576, compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64) -> DataFrame:
    """(id_col, n_bytes, media): each text's UTF-8 bytes as a one-page TIFF of 8-bit samples, row_bytes wide.

    Bytes 255 fill the last row, and an empty or null text is one row of them.
    """

    def run(batches):
        for big in batches:
            for batch in slices(big, 64):
                sizes, media = [], []
                for text in batch.column(1).to_pylist():
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    raw += b"\xff" * (-len(raw) % row_bytes or row_bytes * (not raw))
                    media.append(write([np.frombuffer(raw, np.uint8).reshape(-1, row_bytes)], compression, predictor, rows_per_strip))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def op7_tiff(spark, sf_dir):
    pages = tiff_pages(as_tiff(documents(spark, sf_dir)))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
