"""Media columns: TIFF.

`tiff_pages` reads a column of TIFF files and gives one row per page: it walks
the chain of image directories, decodes PackBits, LZW or deflate strips and
tiles, undoes the horizontal predictor, and reports a broken file as one row
with its error. `text_to_tiff` stores bytes losslessly as such files.

A file is decoded on its own, in the task that holds its row, so a job needs no
shuffle; a task holds one file and its pages at a time. Null media has no
pages. An empty table gives an empty table. Other columns pass through as they
are; a column of the same name as an output is replaced.

The stored form: RGB pages 64 pixels wide (192 bytes a row) and at most 256
rows tall, in strips of 64 rows or tiles of 32 x 32, two across. The checksum of
the payload picks LZW, PackBits or deflate (a third of the payloads each),
layout and predictor, so equal texts give equal files. A text of any length is
joined from its pages once, in the task that decodes them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import slices, table, text_array

# Fixed values of the format: compressions, tags, and the bytes of each field type.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257

ROW_BYTES, PAGE_ROWS, STRIP_ROWS, TILE, PIXELS = 192, 256, 64, 32, 64

PAGE = "struct<page:int,width:int,height:int,samples:int,compression:int,predictor:int,tiled:boolean,pixels:binary,error:string>"


class Broken(ValueError):
    """A file that is not a TIFF this reader knows."""


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literals(to: int) -> None:
        for a in range(at, to, 128):
            out.append(min(128, to - a) - 1)
            out.extend(data[a : min(a + 128, to)])

    for run in regex.finditer(rb"(?s)(.)\1{2,}", data):
        literals(run.start())
        for a in range(run.start(), run.end(), 128):
            n = min(128, run.end() - a)
            out.extend((257 - n, data[a]) if n > 1 else (0, data[a]))
        at = run.end()
    literals(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, end = [], 0, len(data)
    got = 0
    while at < end and got < size:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
            got += n + 1
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            got += 257 - n
        else:
            at += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Most significant bit first; a code grows one entry early, as the format has it."""
    codes, widths = [CLEAR], [9]
    known: dict[int, int] = {}
    free, width, word = 258, 9, -1
    for b in data:
        if word < 0:
            word = b
            continue
        pair = word << 8 | b  # an entry is an earlier one and a byte
        longer = known.get(pair)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        known[pair] = free
        free += 1
        if free == 4095:
            codes.append(CLEAR)
            widths.append(width)
            known, free, width = {}, 258, 9
        elif free >= (1 << width):
            width += 1
        word = b
    if word >= 0:
        codes.append(word)
        widths.append(width)
        free += 1
        if free >= (1 << width) and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    w = np.array(widths)
    ends = np.cumsum(w)
    # The bits of each code, written where the codes before it end.
    at = np.arange(ends[-1])
    of = np.repeat(np.arange(len(w)), w)
    return np.packbits((np.array(codes)[of] >> (ends[of] - 1 - at) & 1).astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, out, got = list(first), [], 0
    bits, held, at, width, last = 0, 0, 0, 9, b""
    end = len(data)
    while got < size:
        while held < width:
            if at >= end:
                return b"".join(out)
            bits = (bits << 8) | data[at]
            at += 1
            held += 8
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == CLEAR:
            known, width, last = list(first), 9, b""
            continue
        if code == END:
            break
        if code < len(known):
            word = known[code]
            if last:
                known.append(last + word[:1])
        elif last and code == len(known):
            word = last + last[:1]
            known.append(word)
        else:
            raise Broken("a code before its entry")
        out.append(word)
        got += len(word)
        last = word
        if len(known) + 1 >= (1 << width) and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise Broken(str(e)) from e


ENCODERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: packbits}
DECODERS: dict[int, Callable[[bytes, int], bytes]] = {NONE: lambda x, n: x[:n], LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpackbits}


#: Bytes that a stored byte of each compression can become at most: a run of 128 from two, a code of 9 bits for the longest entry, a match of 258 from two bits.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


def variant(payload: bytes) -> tuple[int, bool, int]:
    """Compression, tiles or strips, and predictor of a payload, from its checksum."""
    n = zlib.crc32(payload)
    return (LZW, PACKBITS, DEFLATE)[n % 3], bool(n >> 4 & 1), 1 + (n >> 5 & 1)


def encode(payload: bytes) -> bytes:
    """A little-endian TIFF of the payload, whose length is a positive multiple of 192."""
    compression, tiled, predictor = variant(payload)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 3)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(rows), PAGE_ROWS):
        page = rows[top : top + PAGE_ROWS]
        if tiled:
            full = np.concatenate([page, np.zeros((-len(page) % TILE, PIXELS, 3), np.uint8)])
            cells = [full[a : a + TILE, x : x + TILE] for a in range(0, len(full), TILE) for x in range(0, PIXELS, TILE)]
        else:
            cells = [page[a : a + STRIP_ROWS] for a in range(0, len(page), STRIP_ROWS)]
        if predictor == 2:
            cells = [np.concatenate([c[:, :1], c[:, 1:] - c[:, :-1]], axis=1) for c in cells]
        blocks = [ENCODERS[compression](c.tobytes()) for c in cells]
        at = []
        for b in blocks:
            at.append(len(out))
            out += b + b"\0" * (len(b) % 2)

        def longs(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            place = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return place

        n = len(blocks)
        bits = len(out)
        out += struct.pack("<4H", 8, 8, 8, 0)
        fields = [(WIDTH, 3, 1, PIXELS), (HEIGHT, 4, 1, len(page)), (BITS, 3, 3, bits), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 2), (SAMPLES, 3, 1, 3), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        sizes, places = longs([len(b) for b in blocks]), longs(at)
        if tiled:
            fields += [(TILE_WIDTH, 3, 1, TILE), (TILE_LENGTH, 3, 1, TILE), (TILE_OFFSETS, 4, n, places), (TILE_COUNTS, 4, n, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, n, places), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_COUNTS, 4, n, sizes)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in sorted(fields))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """The byte order and the numeric fields of each image directory, in the file's order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise Broken("no TIFF header")
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen = set()
        while at:
            if at in seen:
                raise Broken("directories form a ring")
            seen.add(at)
            (count,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in LETTERS and n:
                    place = at + 10 + 12 * i
                    if FIELD_BYTES[kind] * n > 4:
                        (place,) = struct.unpack_from(order + "I", data, place)
                    if place + FIELD_BYTES[kind] * n > len(data):
                        raise Broken("a field beyond the file's end")
                    fields[tag] = struct.unpack_from(f"{order}{n}{LETTERS[kind]}", data, place)
            yield order, fields
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
    except struct.error as e:
        raise Broken(str(e)) from e


def page_of(data: bytes, fields: dict[int, tuple[int, ...]]) -> dict:
    """One decoded page: its 8-bit samples row by row, samples of a pixel together."""

    def one(tag: int, default: int | None = None) -> int:
        if tag not in fields:
            if default is None:
                raise Broken(f"tag {tag} is missing")
            return default
        return fields[tag][0]

    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, tiled = one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in fields
    if set(fields.get(BITS, (8,))) != {8} or compression not in DECODERS or predictor not in (1, 2) or one(PLANAR, 1) != 1 or not width or not height:
        raise Broken("a layout that is not read here")
    across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not across or not down or not samples:
        raise Broken("blocks without pixels")
    offsets, sizes = (fields.get(x, ()) for x in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    columns, bands = -(-width // across), -(-height // down)
    if len(offsets) != columns * bands or len(sizes) != len(offsets):
        raise Broken("blocks do not cover the page")
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):  # before anything is allocated
        tall = down if tiled else min(down, height - i // columns * down)
        if at + size > len(data) or tall * across * samples > size * EXPANDS[compression]:
            raise Broken("a block that cannot hold its pixels")
    image = np.zeros((bands * down, columns * across, samples), np.uint8)
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        top, left = i // columns * down, i % columns * across
        tall = down if tiled else min(down, height - top)
        raw = DECODERS[compression](data[at : at + size], tall * across * samples)
        if len(raw) < tall * across * samples:
            raise Broken("a block that ends early")
        block = np.frombuffer(raw[: tall * across * samples], np.uint8).reshape(tall, across, samples)
        image[top : top + tall, left : left + across] = np.cumsum(block, axis=1, dtype=np.uint8) if predictor == 2 else block
    pixels = image[:height, :width].tobytes()
    return {"width": width, "height": height, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": pixels, "error": None}


def decode(data: bytes | None) -> list[dict]:
    """The pages of a file; a broken one ends in a row that has only the error."""
    pages: list[dict] = []
    if data is None:
        return pages
    try:
        for _, fields in directories(data):
            pages.append({"page": len(pages), **page_of(data, fields)})
    except Broken as e:
        pages.append({"page": len(pages), "error": str(e)})
    return pages


def read_tiff(df: DataFrame, media: str = "media", out: str = "pages", joined: str | None = None) -> DataFrame:
    """df with the pages of each file as an array, in the file's order; `joined` is a column of all their pixels instead of each page's own."""
    df = df.drop(out, *([joined] if joined else []))
    kind = T._parse_datatype_string(f"array<{PAGE}>")
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind), *([T.StructField(joined, T.BinaryType())] if joined else [])])
    arrow = pa.list_(pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                files = [decode(x) for x in part.column(media).to_pylist()]
                columns, names = [*part.columns], [*part.schema.names, out]
                if joined:
                    whole = pa.array([b"".join(p.pop("pixels", None) or b"" for p in pages) for pages in files], pa.binary())
                    columns, names = [*columns, pa.array(files, arrow), whole], [*names, joined]
                else:
                    columns.append(pa.array(files, arrow))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(read, schema)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the other columns of df, then the page's."""
    clash = [x.split(":")[0] for x in PAGE[7:-1].split(",")]
    kept = [x for x in df.columns if x not in clash and x != media]
    return read_tiff(df, media).select(*kept, F.explode("pages").alias("p")).select(*kept, "p.*")


def text_to_tiff(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with `n_bytes` and `out`: the UTF-8 text, blanks up to a positive multiple of 192, as a TIFF file; the text goes."""
    df = df.drop(out, "n_bytes")
    kept = [x for x in df.columns if x != text]
    schema = T.StructType([*(df.schema[x] for x in kept), T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw = text_array(part, text).cast(pa.binary()).to_pylist()
                files = [encode(x.ljust(max(1, -(-len(x) // ROW_BYTES)) * ROW_BYTES)) for x in raw]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], names=[*kept, "n_bytes", out])

    return df.mapInArrow(store, schema)


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = text_to_tiff(table(spark, sf_dir, "documents").select("doc_id", "text"))
    last = F.element_at("pages", -1)
    feature = F.concat_ws("|", F.format_string("%d pages", F.size("pages")), F.format_string("%dx%d", last["width"], F.aggregate("pages", F.lit(0), lambda n, p: n + p["height"])), F.format_string("compression %d", last["compression"]), F.when(last["tiled"], "tiles").otherwise("strips"), F.format_string("predictor %d", last["predictor"]), F.format_string("%.2f bytes a stored byte", F.octet_length("payload") / F.octet_length("media")))
    back = read_tiff(files, joined="payload")
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


QUERIES = {"op8_tiff_pages": op8_tiff_pages}
