"""TIFF media columns: one row per page.

`pages` walks the image directories of a file and decodes their strips or tiles
(stored, PackBits, LZW or deflate, with the horizontal predictor) of 8- or 16-bit
samples. `encode` writes such files, so that bytes can be kept as images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tag numbers, and size and struct code of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 16: "Q"}
#: Samples that a page may have; beyond it, or if a directory is met again, the file counts as broken.
MOST_SAMPLES = 1 << 28


class BrokenImage(ValueError):
    """Bytes that aren't a TIFF file of the kinds that are read here."""


def pack_bits(data: bytes) -> bytes:
    out, k, n = bytearray(), 0, len(data)
    while k < n:
        run = 1
        while run < 128 and k + run < n and data[k + run] == data[k]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[k]))
            k += run
            continue
        stop = k
        while stop < n and stop - k < 128 and not (stop + 2 < n and data[stop] == data[stop + 1] == data[stop + 2]):
            stop += 1
        out.append(stop - k - 1)
        out += data[k:stop]
        k = stop
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, k = bytearray(), 0
    while len(out) < size:
        if k >= len(data):
            raise BrokenImage("PackBits data ends early")
        head = data[k]
        if head < 128:
            out += data[k + 1 : k + 2 + head]
            k += head + 2
        else:
            if head > 128:
                out += data[k + 1 : k + 2] * (257 - head)
            k += 2 if head > 128 else 1
    return bytes(out[:size])


CLEAR, STOP, FIRST, MOST_BITS = 256, 257, 258, 12


def lzw(data: bytes) -> bytes:
    """Most significant bit first; a code's width grows one code early, as this format has it."""
    bits = used = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, used
        bits, used = bits << width | code, used + width
        while used >= 8:
            used -= 8
            out.append(bits >> used & 255)
        bits &= (1 << used) - 1

    codes: dict[tuple[int, int], int] = {}
    width, free = 9, FIRST
    put(CLEAR, width)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        known = codes.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        put(prefix, width)
        codes[prefix, byte] = free
        free += 1
        prefix = byte
        if free == 1 << width and width < MOST_BITS:
            width += 1
        elif free == (1 << MOST_BITS) - 1:
            put(CLEAR, width)
            codes.clear()
            width, free = 9, FIRST
    if prefix >= 0:
        put(prefix, width)
        if free + 1 == 1 << width and width < MOST_BITS:
            width += 1
    put(STOP, width)
    if used:
        out.append(bits << (8 - used) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, bits, used, k = bytearray(), 0, 0, 0
    entries = [bytes((x,)) for x in range(256)] + [b"", b""]
    width, last = 9, None
    while len(out) < size:
        while used < width:
            if k >= len(data):
                raise BrokenImage("LZW data ends early")
            bits, used, k = bits << 8 | data[k], used + 8, k + 1
        used -= width
        code = bits >> used
        bits &= (1 << used) - 1
        if code == STOP:
            break
        if code == CLEAR:
            del entries[FIRST:]
            width, last = 9, None
            continue
        if last is None:
            if code >= CLEAR:
                raise BrokenImage("LZW data has a code before its entry")
            entry = entries[code]
        else:
            if code > len(entries):
                raise BrokenImage("LZW data has a code before its entry")
            entry = entries[code] if code < len(entries) else last + last[:1]
            entries.append(last + entry[:1])
            if len(entries) >= (1 << width) - 1 and width < MOST_BITS:
                width += 1
        out += entry
        last = entry
    if len(out) < size:
        raise BrokenImage("LZW data is short")
    return bytes(out[:size])


def _inflate(data: bytes, size: int) -> bytes:
    reader = zlib.decompressobj()
    try:
        out = reader.decompress(data, size)
    except zlib.error as e:
        raise BrokenImage(str(e)) from e
    if len(out) < size:
        raise BrokenImage("deflate data is short")
    return out


def _stored(data: bytes, size: int) -> bytes:
    if len(data) < size:
        raise BrokenImage("data is short")
    return data[:size]


DECODERS = {NONE: _stored, PACKBITS: unpack_bits, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
ENCODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 6)}


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    segments: int
    pixels: np.ndarray  # height x width x samples


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        code = f"{order}{count}{TYPES[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(code) > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + struct.calcsize(code) > len(data):
            raise BrokenImage("a field lies beyond the file")
        tags[tag] = struct.unpack_from(code, data, place)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, following


def pages(data: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of their directories. None and b"" have none; raises BrokenImage."""
    if not data:
        return
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise BrokenImage("no TIFF header")
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise BrokenImage("directories form a circle")
            seen.add(at)
            tags, following = _directory(data, order, at)
            yield _page(data, order, tags, len(seen) - 1)
            at = following
    except struct.error as e:
        raise BrokenImage(str(e)) from e


def _page(data: bytes, order: str, tags: dict[int, tuple[int, ...]], index: int) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples, compression, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = tags.get(BITS, (1,))
    if len(set(bits)) > 1 or bits[0] not in (8, 16) or compression not in DECODERS or predictor not in (1, 2):
        raise BrokenImage(f"unsupported: {bits} bits, compression {compression}, predictor {predictor}")
    if not 0 < width * height * samples <= MOST_SAMPLES:
        raise BrokenImage(f"a page of {width} x {height} x {samples}")
    planes, depth = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, high, offsets, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())
    else:
        wide, high, offsets, sizes = width, min(one(ROWS, height), height), tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
    if not wide or not high:
        raise BrokenImage("segments without a size")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise BrokenImage("segments are missing")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, row, column = k // (across * down), k // across % down * high, k % across * wide
        rows = high if tiled else min(high, height - row)
        raw = DECODERS[compression](data[offsets[k] : offsets[k] + sizes[k]], rows * wide * depth * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=pixels.dtype)
        part = part[: height - row, : width - column]
        pixels[row : row + part.shape[0], column : column + part.shape[1], plane if planes > 1 else slice(None)] = part[..., 0] if planes > 1 else part
    return Page(index, width, height, samples, bits[0], compression, predictor, tiled, across * down * planes, pixels)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of one page per image: height x width (x samples) arrays of 8- or 16-bit samples."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        wide, high = tile or (width, min(rows, height))
        kind = image.dtype.newbyteorder(order)
        offsets, sizes = [], []
        for row in range(0, height, high):
            for column in range(0, width, wide):
                part = image[row : row + high, column : column + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = ENCODERS[compression](np.ascontiguousarray(part, kind).tobytes())
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        out += bytes(len(out) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8 * image.dtype.itemsize] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [wide], TILE_HEIGHT: [high], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS: [high], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            short = max(values) < 1 << 16 and tag not in (STRIP_OFFSETS, STRIP_BYTES, TILE_OFFSETS, TILE_BYTES)
            raw = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            entries += struct.pack(f"{order}HHI", tag, 3 if short else 4, len(values))
            if len(raw) > 4:
                entries += struct.pack(f"{order}I", len(out))
                out += raw + bytes(len(raw) % 2)
            else:
                entries += raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(f"{order}I", len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


PAGE_FIELDS = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("segments", T.LongType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def explode_pages(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each file: its id, the PAGE_FIELDS, pixels as the bytes of the samples in machine order, row by row.

    A null or empty file has no rows. A file that can't be read gives the pages
    before the fault and one row with the error and nulls. Equal files and ids
    give equal rows; other columns of files are left out.
    """
    kind = files.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *PAGE_FIELDS.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                rows = []
                try:
                    for p in pages(data.as_py()):
                        rows.append((p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.segments, p.pixels.tobytes(), None))
                except BrokenImage as e:
                    rows.append((*[None] * 10, str(e)))
                if rows:
                    own = batch.column(0).take(pa.array([i] * len(rows)))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names)

    return in_arrow(files.select(id_col, media_col), run, schema)


#: Texts as images: samples in a row, rows of a page and of a strip.
ROW, PAGE_ROWS, STRIP_ROWS = 576, 1024, 64
PAD = 255


def text_images(payload: bytes) -> list[np.ndarray]:
    """Padded text as 8-bit pages ROW wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]


def store_texts(docs: DataFrame) -> DataFrame:
    """(key struct<doc_id, n_bytes, media_bytes, media_sha256>, media binary) for every row of docs.

    A text's UTF-8 bytes, none for null, are padded with bytes 255 to a positive
    multiple of ROW and kept as a deflated multi-page TIFF file.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()),
            T.StructField("media", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for k in range(0, len(texts), 256):
                sizes, sums, files = [], [], []
                for text in texts[k : k + 256]:
                    data = text.as_py() or b""
                    sizes.append(len(data))
                    data += bytes([PAD]) * (-len(data) % ROW if data else ROW)
                    files.append(encode(text_images(data), DEFLATE, 2, STRIP_ROWS))
                    sums.append(sha256(files[-1]).hexdigest())
                arrays = [batch.column(0)[k : k + 256], pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    stored = in_arrow(docs.select("doc_id", "text"), run, schema)
    key = F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), "media_sha256")
    return stored.select(key.alias("key"), "media")


class _Digest:
    """What is known of a file after some of its pages."""

    def __init__(self, key):
        self.key, self.size, self.pages, self.sum, self.tail = key, 0, 0, sha256(), b""
        self.counts, self.grid = np.zeros(256, np.int64), []

    def add(self, pixels: bytes) -> None:
        self.size += len(pixels)
        self.pages += 1
        self.sum.update(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        samples = np.frombuffer(pixels, np.uint8)
        self.counts += np.bincount(samples, minlength=256)
        self.grid.append(samples.reshape(-1, ROW // 9, 9).sum(axis=(0, 2)))

    def feature(self) -> str:
        """Pages, mean, deviation and entropy of the samples, and the 64-bit average hash of the 64 columns."""
        share = self.counts / self.size
        mean = float(share @ np.arange(256))
        deviation = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
        entropy = -float(share[share > 0] @ np.log2(share[share > 0]))
        columns = np.sum(self.grid, axis=0)
        bits = int(np.packbits(columns * 64 > columns.sum()).view(">u8")[0])
        return f"pages={self.pages};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};hash={bits:016x}"


def digests(pages_of_texts: DataFrame) -> DataFrame:
    """One row per file of store_texts from its pages, which follow each other in one partition as explode_pages leaves them."""
    id_kind = pages_of_texts.schema["key"].dataType["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_kind)]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "payload_bytes")]
        + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("media_sha256", "feature")]
    )

    def rows(found: list[_Digest]) -> pa.RecordBatch:
        key = lambda name: [d.key[name] for d in found]
        longs = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key("doc_id"), pa.string() if id_kind == T.StringType() else pa.int64()),
                longs(key("n_bytes")),
                longs([d.size for d in found]),
                pa.array([d.sum.hexdigest() for d in found], pa.string()),
                longs([zlib.crc32(d.tail) for d in found]),
                longs(key("media_bytes")),
                pa.array(key("media_sha256"), pa.string()),
                pa.array([d.feature() for d in found], pa.string()),
            ],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for key, page, pixels, error in zip(*(batch.column(k) for k in range(4))):
                if error.is_valid:
                    raise BrokenImage(f"{key}: {error}")
                if page.as_py() == 0:
                    if now:
                        done.append(now)
                    now = _Digest(key.as_py())
                now.add(pixels.as_py())
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    return in_arrow(pages_of_texts.select("key", "page", "pixels", "error"), run, schema)
