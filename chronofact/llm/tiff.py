"""TIFF as a media column: a reader that emits a row for each page, and a writer to store bytes losslessly.

The reader walks the chain of image directories of classic TIFF in either byte order, decodes strips or tiles that
are plain, PackBits, LZW or deflate, undoes predictors and gives each page's samples row by row: 1, 2, 4, 8, 16 or 32
bits, the first three as a byte each, the others in the file's byte order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.storage import BATCH_BYTES, tidy, tune

# Fixed values of the TIFF 6.0 format: tags, types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: Bytes that one stored byte can stand for at most, in any of the schemes; a page that claims more is broken.
MOST_RATIO = 4096
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class BadTiff(ValueError):
    """The bytes are no TIFF file, or use what this reader does not know."""


@dataclass(frozen=True)
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    #: Samples row by row, of under 8 bits in a byte each; of planes stored apart, interleaved again.
    pixels: bytes


def unpack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats, all else literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cuts = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], cuts])
    lengths = np.diff(np.concatenate([starts, [len(a)]]))
    out, literal = bytearray(), 0

    def flush(upto: int) -> None:
        for k in range(literal, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        flush(s)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out += bytes([257 - m if m > 1 else 0, data[s]])
        literal = s + n
    flush(len(data))
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends the data."""
    out: list[bytes] = []
    table, last, width, held, bits = [], b"", 9, 0, 0
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(fresh)
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, last, width = list(fresh), b"", 9
            continue
        if code == 257:
            break
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise BadTiff("LZW code out of range")
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    fresh = {bytes([i]): i for i in range(256)}
    table, width, now, after = dict(fresh), 9, b"", 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for byte in data:
        longer = now + bytes([byte])
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer] = after
        after += 1
        now = longer[-1:]
        if after == 4094:
            width = 12
            put(256)
            table, width, after = dict(fresh), 9, 258
        else:
            width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    if now:
        put(table[now])
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_packbits}


def read_pages(blob: bytes) -> Iterator[Page]:
    """Every page in the order of the directories; BadTiff if the bytes are cut off, circular or unknown."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(blob[:2])]
        magic, at = struct.unpack_from(order + "HI", blob, 2)
        if magic != 42:
            raise BadTiff("not a classic TIFF file")
        number, seen = 0, set()
        while at:
            if at in seen:
                raise BadTiff("directories form a circle")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", blob, at)
            tags = dict(_entry(blob, order, at + 2 + 12 * i) for i in range(n))
            yield _page(blob, order, number, tags)
            (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
            number += 1
    except BadTiff:
        raise
    except (LookupError, struct.error, zlib.error, ArithmeticError, TypeError, ValueError, MemoryError) as e:
        raise BadTiff(f"broken TIFF: {e!r}") from e


def _entry(blob: bytes, order: str, at: int) -> tuple[int, tuple[int, ...]]:
    tag, kind, n = struct.unpack_from(order + "HHI", blob, at)
    if kind not in _TYPES:
        return tag, ()
    size = struct.calcsize(_TYPES[kind]) * n
    where = at + 8 if size <= 4 else struct.unpack_from(order + "I", blob, at + 8)[0]
    return tag, struct.unpack_from(f"{order}{n}{_TYPES[kind]}", blob, where)


def _page(blob: bytes, order: str, number: int, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    width, height, samples, scheme, predictor = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = set(tags.get(BITS) or (1,))
    if len(bits) != 1 or not bits <= {1, 2, 4, 8, 16, 32} or scheme not in _UNPACK or predictor not in (1, 2, 3) or (predictor == 2 and bits < {8}) or (predictor == 3 and bits != {32}):
        raise BadTiff(f"bits {sorted(bits)}, compression {scheme}, predictor {predictor}")
    (deep,) = bits
    kind = np.dtype({16: order + "u2", 32: order + "u4"}.get(deep, "u1"))
    apart = one(PLANAR, 1) == 2 and samples > 1
    depth = 1 if apart else samples
    tiled = TILE_AT in tags
    cell_w, cell_h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    where, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    if min(width, height, samples, cell_w, cell_h) < 1 or len(where) != len(sizes):
        raise BadTiff(f"{width} x {height} x {samples} in cells of {cell_w} x {cell_h}, {len(where)} places, {len(sizes)} sizes")
    stored = sum(min(n, len(blob)) for n in sizes)
    if max(width * height * samples, cell_w * cell_h * depth) * deep > 8 * MOST_RATIO * (stored + 1):
        raise BadTiff(f"{width} x {height} x {samples} samples from {stored} bytes")
    across, down = -(-width // cell_w), -(-height // cell_h)
    if len(where) < across * down * (samples if apart else 1):
        raise BadTiff("strips or tiles are missing")
    image = np.zeros((height, width, samples), kind)
    for i, (a, n) in enumerate(zip(where, sizes, strict=True)):
        plane, cell = divmod(i, across * down)
        top, left = cell // across * cell_h, cell % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - top)
        data = blob[a : a + n]
        raw = _UNPACK[scheme](data.translate(_MIRRORED) if one(FILL_ORDER, 1) == 2 else data)
        part = _cell(raw, rows, cell_w, depth, deep, kind, predictor)[: height - top, : width - left]
        image[top : top + part.shape[0], left : left + part.shape[1], slice(plane, plane + 1) if apart else slice(None)] = part
    return Page(number, width, height, samples, deep, scheme, predictor, image.tobytes())


def _cell(raw: bytes, rows: int, width: int, depth: int, deep: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """Samples of one strip or tile; its rows begin at whole bytes."""
    line = -(-width * depth * deep // 8)
    if len(raw) < rows * line:
        raise BadTiff("a strip or tile is too short")
    packed = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
    if deep < 8:
        ones = np.unpackbits(packed, axis=1).reshape(rows, -1, deep)
        values = ones @ (1 << np.arange(deep - 1, -1, -1)).astype(np.uint8)
        return values[:, : width * depth].reshape(rows, width, depth)
    if predictor == 3:  # bytes of floats, the highest ones first, each less the one of the sample before
        summed = np.cumsum(packed.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, deep // 8, width * depth)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">u{deep // 8}").reshape(rows, width, depth)
    part = packed.view(kind).reshape(rows, width, depth)
    return np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part


def write_tiff(pixels: bytes, width: int, samples: int = 1, compression: int = DEFLATE, predictor: int = 2, page_rows: int = 1024, strip_rows: int = 256, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """Little-endian TIFF of 8-bit samples; an image of more than ``page_rows`` rows goes on in further pages."""
    pack = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, level), PACKBITS: pack_packbits}[compression]
    image = np.frombuffer(pixels, np.uint8).reshape(-1, width, samples)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        cell_h, cell_w = tile or (strip_rows, width)
        where, sizes = [], []
        for r in range(0, len(page), cell_h):
            for c in range(0, width, cell_w):
                part = page[r : r + cell_h, c : c + cell_w]
                if tile:
                    part = np.pad(part, ((0, cell_h - part.shape[0]), (0, cell_w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = pack(part.tobytes())
                where.append(len(out))
                sizes.append(len(data))
                out += data
                out += b"\0" * (len(out) % 2)
        shorts = {WIDTH: [width], HEIGHT: [len(page)], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        longs = {TILE_WIDTH: [cell_w], TILE_HEIGHT: [cell_h], TILE_AT: where, TILE_BYTES: sizes} if tile else {STRIP_AT: where, ROWS_PER_STRIP: [cell_h], STRIP_BYTES: sizes}
        entries = b""
        for tag, kind, values in sorted([(t, "I", v) for t, v in longs.items()] + [(t, "I" if t in (WIDTH, HEIGHT) else "H", v) for t, v in shorts.items()]):
            data = struct.pack(f"<{len(values)}{kind}", *values)
            if len(data) > 4:
                data, at = struct.pack("<I", len(out)), out.extend(data)
                out += b"\0" * (len(out) % 2)
            entries += struct.pack("<HHI", tag, 3 if kind == "H" else 4, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries) // 12) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", columns: Sequence[str] = ()) -> DataFrame:
    """A row for each page: ``doc_id`` (and ``columns``), ``page, width, height, samples, bits, compression, predictor,
    pixels, error``; the pages of one media value follow each other.

    Null or empty media give no row; media that cannot be read, whatever is wrong with them, give one row with ``error``
    and nulls otherwise, after the pages that could. Repeated rows give their pages again; columns that are not asked
    for are not carried.
    """
    tune(df.sparkSession)
    carried = df.select(id_col, *columns)
    names = [*carried.columns, "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema) + ", " + ", ".join(f"{c} int" for c in names[-9:-2]) + ", pixels binary, error string"
    types = [pa.int32()] * 7 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, held = [], [], 0

            def flush(b=b) -> pa.RecordBatch:
                values = zip(*rows, strict=True) if rows else [()] * 9
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *(pa.array(list(c), t) for c, t in zip(values, types, strict=True))], names=names)

            for i, blob in enumerate(b.column(len(names) - 9)):
                for row in _rows(blob.as_py()):
                    at.append(i)
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held > BATCH_BYTES:
                        yield flush()
                        at, rows, held = [], [], 0
            yield flush()

    return df.select(id_col, *columns, F.col(media_col).alias("__media")).mapInArrow(tidy(run), schema)


def _rows(blob: bytes | None) -> Iterator[tuple]:
    try:
        for p in read_pages(blob) if blob else ():
            yield p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, None
    except BadTiff as e:
        yield *[None] * 8, str(e)


def tiff_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, samples: int = 3, page_rows: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, media_bytes, media_sha256, media``: each text's UTF-8 (null: empty), with bytes 32 up to a
    positive multiple of a row's ``width`` x ``samples`` bytes, as a TIFF of as many pages as its rows fill."""
    tune(df.sparkSession)
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    row = width * samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.pieces(batch, "text"):
                texts = [t.as_py() or b"" for t in b.column(1)]
                media = [write_tiff(t.ljust(max(row, -(-len(t) // row) * row), b" "), width, samples, page_rows=page_rows) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media_bytes", "media_sha256", "media"])

    return df.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, media_bytes long, media_sha256 string, media binary")


class _Payload:
    """What the pages of one media value hold together; only counts and the last bytes are kept."""

    def __init__(self) -> None:
        self.sha, self.tail, self.size, self.pages, self.rows, self.values = hashlib.sha256(), b"", 0, 0, 0, np.zeros(256, np.int64)

    def add(self, rows: int, pixels: bytes) -> None:
        self.sha.update(pixels)
        self.tail = (self.tail + pixels[-16:])[-16:]
        self.size, self.pages, self.rows = self.size + len(pixels), self.pages + 1, self.rows + rows
        self.values += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)

    def result(self) -> tuple[int, str, int, str]:
        seen = np.flatnonzero(self.values)
        total, bands = int((self.values * np.arange(256)).sum()), ",".join(map(str, self.values.reshape(8, 32).sum(1).tolist()))
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), f"pages={self.pages};rows={self.rows};sum={total};min={seen.min()};max={seen.max()};bands={bands}"


def tiff_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, samples: int = 3, page_rows: int = 1024) -> DataFrame:
    """Stores each text as a TIFF (``tiff_media``), reads its pages back (``tiff_pages``) and describes what they hold.

    One row for each row of ``df``; equal texts give equal values. Pages stream from reader to digest in one partition,
    so no page is shuffled and a worker holds one batch of pages at a time.
    """
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    pages = tiff_pages(tiff_media(df, id_col, text_col, width, samples, page_rows), id_col, columns=["n_bytes", "media_bytes", "media_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = whole = None

        def row() -> pa.RecordBatch:
            n, size, sha = (c[0].as_py() for c in last.columns[1:4])
            payload, digest, tail, feature = whole.result()
            return pa.RecordBatch.from_arrays([last.column(0), *(pa.array([v], t) for v, t in zip((n, payload, digest, tail, size, sha, feature), types, strict=True))], names=names)

        for b in batches:
            done = []
            for i, (page, rows, pixels, error) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page", "height", "pixels", "error")), strict=True)):
                if error:
                    raise BadTiff(error)
                if page == 0:
                    if whole:
                        done.append(row())
                    last, whole = b.slice(i, 1), _Payload()
                whole.add(rows, pixels)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if whole:
            yield row()

    return pages.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
