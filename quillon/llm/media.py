"""Media columns: TIFF.

The reader walks the image directories of a file (classic TIFF, either byte order), decodes uncompressed, PackBits, LZW and
deflate data of strips or tiles, undoes the horizontal predictor, and gives one row a page. The writer makes such files of
8-bit grey samples.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

#: Fixed values of the TIFF 6.0 format: tags, compressions, bytes of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END, FIRST = 256, 257, 258

#: Of the files that op8 writes: samples in a row, rows of a page and of a strip at most, side of a tile, compressions.
PAYLOAD_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_SIDE = 64, 1024, 128, 64
COMPRESSIONS = (RAW, PACKBITS, LZW, DEFLATE)
#: Bytes of payload or samples of a batch, about; a file's pages are never parted.
BATCH_BYTES = 4_000_000


class BadTiff(ValueError):
    """The bytes are not a TIFF file that this reader knows."""


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    predictor: int
    samples: np.ndarray  # height x width x channels


# --- codecs


def packbits(data: bytes) -> bytes:
    """Runs of three and more as runs, all else as it stands."""
    out, at = bytearray(), 0

    def plain(upto: int) -> None:
        nonlocal at
        while at < upto:
            n = min(128, upto - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        plain(run.start())
        out.extend((257 - len(run[0]), run[1][0]))
        at = run.end()
    plain(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the code grows one entry early, as readers expect."""
    out, held, held_bits = bytearray(), 0, 0
    known: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, held_bits
        width = min(12, (FIRST + len(known)).bit_length()) if known else 9
        held = held << width | code
        held_bits += width
        while held_bits >= 8:
            held_bits -= 8
            out.append(held >> held_bits & 255)
        held &= (1 << held_bits) - 1

    put(CLEAR)
    word = b""
    code_of = lambda w: w[0] if len(w) == 1 else known[w]
    for b in data:
        longer = word + bytes((b,))
        if len(longer) == 1 or longer in known:
            word = longer
            continue
        put(code_of(word))
        known[longer] = FIRST + len(known)
        if FIRST + len(known) == 4094:
            put(CLEAR)
            known.clear()
        word = longer[-1:]
    if word:
        put(code_of(word))
        known[b"end of data"] = 0  # the reader adds an entry here too
    put(END)
    if held_bits:
        out.append(held << (8 - held_bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, held, held_bits, width = bytearray(), 0, 0, 9
    entries: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    last = b""
    for b in data:
        held = (held << 8 | b) & 0xFFFFFF
        held_bits += 8
        if held_bits < width:
            continue
        held_bits -= width
        code = held >> held_bits & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            del entries[FIRST:]
            width, last = 9, b""
            continue
        if code < len(entries):
            entry = entries[code]
        elif last and code == len(entries):
            entry = last + last[:1]
        else:
            raise BadTiff("LZW code out of order")
        out += entry
        if last:
            entries.append(last + entry[:1])
        last = entry
        if len(entries) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def decoded(data: bytes, compression: int, size: int) -> bytes:
    """The size bytes that data holds; short data is filled with 0, as no more of the page is known."""
    if compression == RAW:
        out = data
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, max(1, size))
        except zlib.error as e:
            raise BadTiff(str(e)) from None
    else:
        raise BadTiff(f"compression {compression}")
    return out[:size].ljust(size, b"\0")


def encoded(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: zlib.compress}[compression](data)


# --- files


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit grey pages, in strips, or in square tiles of that many samples (a multiple of 16) a side."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for page in pages:
        height, width = page.shape
        if tile:
            boxes = [np.pad(part := page[y : y + tile, x : x + tile], ((0, tile - part.shape[0]), (0, tile - part.shape[1]))) for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            boxes = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        where, sizes = [], []
        for box in boxes:
            if predictor == 2:
                box = np.diff(box, axis=1, prepend=np.zeros((box.shape[0], 1), np.uint8))
            data = encoded(np.ascontiguousarray(box).tobytes(), compression)
            where.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = {WIDTH: [width], LENGTH: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: where, TILE_COUNTS: sizes} if tile else {OFFSETS: where, ROWS: [strip_rows], COUNTS: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                packed, at = struct.pack("<I", len(out)), packed
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The whole-number fields of a directory, and where the next one is."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields: dict[int, list[int]] = {}
    for k in range(n):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        if kind not in (1, 3, 4):
            continue
        size = TYPE_BYTES[kind] * count
        place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place))
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def read_tiff(data: bytes) -> list[Page]:
    """All pages in order. Raises BadTiff where the bytes aren't such a file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise BadTiff("no TIFF header")
    pages, been = [], set()
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        while at:
            if at in been:
                raise BadTiff("directories in a circle")
            been.add(at)
            fields, at = _directory(data, at, order)
            pages.append(_page(data, fields, order))
    except (struct.error, KeyError, IndexError, MemoryError) as e:
        raise BadTiff(f"cut short or out of bounds: {e}") from None
    return pages


def _page(data: bytes, fields: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, channels, bits = fields[WIDTH][0], fields[LENGTH][0], one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planes = one(COMPRESSION, RAW), one(PREDICTOR, 1), 1
    if bits not in (8, 16) or predictor not in (1, 2) or any(b != bits for b in fields.get(BITS, [bits])):
        raise BadTiff(f"{bits} bits with predictor {predictor}")
    if one(PLANAR, 1) == 2:
        planes, channels = channels, 1
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS, height), max(1, height)))
    where, sizes = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[OFFSETS], fields[COUNTS])
    if not (0 < across and 0 < down) or width * height * channels * planes * (bits // 8) > 1 << 31:
        raise BadTiff("sizes out of bounds")
    out = np.zeros((planes, height, width, channels), kind.newbyteorder("="))
    boxes = [(p, y, x) for p in range(planes) for y in range(0, height, down) for x in range(0, width, across)]
    if len(where) < len(boxes):
        raise BadTiff("strips or tiles are missing")
    for (p, y, x), begin, size in zip(boxes, where, sizes, strict=False):
        rows = down if tiled else min(down, height - y)
        raw = decoded(data[begin : begin + size], compression, rows * across * channels * (bits // 8))
        box = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(rows, across, channels)
        if predictor == 2:
            box = np.cumsum(box, axis=1, dtype=box.dtype)
        out[p, y : y + rows, x : x + across] = box[: height - y, : width - x]
    samples = out[0] if planes == 1 else np.concatenate(list(out), axis=2)
    return Page(width, height, channels * planes, bits, compression, predictor, samples)


PAGE = pa.schema([*((name, pa.int32()) for name in "page width height channels bits compression".split()), ("samples", pa.binary()), ("error", pa.string())])
PAGE_SCHEMA = "page int, width int, height int, channels int, bits int, compression int, samples binary, error string"


def page_batches(media: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What pages() does in a task: batches with files in column `media` -> batches of a row a page, of BATCH_BYTES of samples or little more."""

    def rows_of(data: bytes | None) -> list[tuple]:
        if not data:
            return []
        try:
            return [(i, p.width, p.height, p.channels, p.bits, p.compression, p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes(), None) for i, p in enumerate(read_tiff(data))]
        except BadTiff as e:
            return [(None,) * 7 + (str(e),)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select([c for c in batch.schema.names if c not in (*PAGE.names, media)])

            def made(at: list[int], rows: list[tuple], others: pa.RecordBatch = others) -> pa.RecordBatch:
                kept = others.take(pa.array(at, pa.int32()))
                found = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PAGE, strict=True)]
                return pa.RecordBatch.from_arrays([*kept.columns, *found], schema=pa.schema([*kept.schema, *PAGE]))

            at, rows, size = [], [], 0
            for k, data in enumerate(batch.column(media)):
                found = rows_of(data.as_py())
                at += [k] * len(found)
                rows += found
                size += sum(len(r[6] or b"") for r in found)
                if size >= BATCH_BYTES:
                    yield made(at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield made(at, rows)

    return of


def pages(df: DataFrame, media: str) -> DataFrame:
    """One row for each page of the files in column `media`, beside the other columns of df.

    A null or empty file has no rows; a file that can't be read has one, with its error and no samples. Samples are row by row, channels last,
    16-bit ones little-endian. A column of df that has a name of PAGE_SCHEMA is replaced."""
    others = [f for f in df.schema if f.name not in (*PAGE.names, media)]
    return df.mapInArrow(page_batches(media), StructType([*others, *StructType.fromDDL(PAGE_SCHEMA)]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, filled with 0 to a positive multiple of PAYLOAD_WIDTH; how many they were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // PAYLOAD_WIDTH)) * PAYLOAD_WIDTH, b"\0"), len(raw)


def form_of(payload: bytes) -> tuple[int, int, int]:
    """Compression, predictor and side of a tile (0: strips) that a payload is stored with: its checksum chooses, so that all are in use and equal payloads are stored alike."""
    draw = zlib.crc32(payload)
    return COMPRESSIONS[draw % 4], 1 + draw // 4 % 2, TILE_SIDE * (draw // 8 % 2)


def stored(payload: bytes) -> bytes:
    """The payload as a file of pages of PAYLOAD_WIDTH samples a row."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)
    compression, predictor, tile = form_of(payload)
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile)


FILE = pa.schema([("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media", pa.binary())])
FILE_SQL = "n_bytes long, media_bytes long, media_sha256 string, media binary"
DIGEST = pa.schema([(name, kind) for kinds, kind in (("doc_id n_bytes payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32 media_bytes", pa.int64()), ("media_sha256 feature", pa.string())) for name in kinds.split()])
DIGEST_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Digest:
    """Of one file, page after page: what op8 returns. No more than a page is held."""

    def __init__(self, doc_id: int | None, n_bytes: int, media_bytes: int, media_sha256: str):
        self.given = doc_id, n_bytes, media_bytes, media_sha256
        self.pages, self.height, self.width, self.compressions = 0, 0, 0, []
        self.sha, self.tail, self.levels = hashlib.sha256(), b"", np.zeros(256, np.int64)

    def add(self, width: int, height: int, compression: int, samples: bytes) -> None:
        self.pages, self.width, self.height = self.pages + 1, width, self.height + height
        self.compressions += [compression] if compression not in self.compressions else []
        self.sha.update(samples)
        self.tail = (self.tail + samples[-PAYLOAD_WIDTH:])[-PAYLOAD_WIDTH:]
        self.levels += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def row(self) -> tuple:
        doc_id, n_bytes, media_bytes, media_sha256 = self.given
        n, level = int(self.levels.sum()), np.arange(256)
        mean = float(self.levels @ level) / n
        std = math.sqrt(max(0.0, float(self.levels @ (level * level)) / n - mean * mean))
        feature = f"pages={self.pages};size={self.width}x{self.height};compression={','.join(map(str, self.compressions))};mean={mean:.4f};std={std:.4f};levels={int((self.levels > 0).sum())}"
        return doc_id, n_bytes, n, self.sha.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages() -> a row a file. The pages of a file follow each other in one partition; each file has a page 0."""
    open_: Digest | None = None
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if r["page"] == 0:
                found += [open_.row()] if open_ else []
                open_ = Digest(r["doc_id"], r["n_bytes"], r["media_bytes"], r["media_sha256"])
            open_.add(r["width"], r["height"], r["compression"], r["samples"])
        yield _digest_batch(found)
    if open_:
        yield _digest_batch([open_.row()])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, DIGEST, strict=True)], schema=DIGEST)


def file_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What files() does in a task: doc_id, text -> doc_id, n_bytes, media_bytes, media_sha256, media, in batches of BATCH_BYTES of payload or little more."""
    for batch in batches:
        ids = batch.column("doc_id")
        begin, rows, size = 0, [], 0
        for k, text in enumerate(batch.column("text")):
            payload, n = payload_of(text.as_py())
            media = stored(payload)
            rows.append((n, len(media), hashlib.sha256(media).hexdigest(), media))
            size += len(payload)
            if size >= BATCH_BYTES or k + 1 == len(batch):
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FILE, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(rows)), *columns], schema=pa.schema([batch.schema.field("doc_id"), *FILE]))
                begin, rows, size = k + 1, [], 0


def files(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, media of each row of docs (doc_id, text): the text's bytes, and the file that holds them."""
    return docs.select("doc_id", "text").mapInArrow(file_batches, StructType([docs.schema["doc_id"], *StructType.fromDDL(FILE_SQL)]))


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """files(), pages() and what op8 returns of them, one after the other in one Python worker of a task: no file and no page goes through the JVM."""
    return _digests(page_batches("media")(file_batches(batches)))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text stored as a TIFF file, which is read back page by page. Null texts are empty, ids are carried as they are, repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(digest_batches, DIGEST_SQL)
