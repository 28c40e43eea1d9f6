"""Image decoders: bytes to frames of raw RGBA, chosen by their first bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Frame = tuple[int, int, int, bytes]  # delay in ms, width, height, RGBA
LIMIT = 1 << 28


def checked(width: int, height: int, channels: int = 4, most: int = (1 << 31) - 2) -> int:
    """Bytes of an image; ValueError if a side is zero or it is over the limit."""
    size = width * height * channels
    if width <= 0 or height <= 0 or channels <= 0 or size > most:
        raise ValueError(f"image of {width} by {height} is out of range")
    return size


def decode_qoi(data: bytes) -> Iterator[Frame]:
    width, height = struct.unpack(">II", data[4:12])
    n = checked(width, height) // 4
    out = bytearray(n * 4)
    seen = [(0, 0, 0, 0)] * 64
    r, g, b, a = 0, 0, 0, 255
    at, k = 14, 0
    while k < n:
        tag = data[at]
        at += 1
        run = 1
        if tag == 0xFE:
            r, g, b = data[at : at + 3]
            at += 3
        elif tag == 0xFF:
            r, g, b, a = data[at : at + 4]
            at += 4
        elif tag >> 6 == 0:
            r, g, b, a = seen[tag]
        elif tag >> 6 == 1:
            r, g, b = (r + (tag >> 4 & 3) - 2) & 255, (g + (tag >> 2 & 3) - 2) & 255, (b + (tag & 3) - 2) & 255
        elif tag >> 6 == 2:
            up, more = (tag & 63) - 32, data[at]
            at += 1
            r, g, b = (r + up + (more >> 4) - 8) & 255, (g + up) & 255, (b + up + (more & 15) - 8) & 255
        else:
            run = (tag & 63) + 1
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        run = min(run, n - k)
        out[k * 4 : (k + run) * 4] = bytes((r, g, b, a)) * run
        k += run
    yield 0, width, height, bytes(out)


def decode_xwd(data: bytes) -> Iterator[Frame]:
    """X window dumps of 24 or 32 bits a pixel; masks give the channels."""
    (head,) = struct.unpack(">I", data[:4])
    fields = struct.unpack(">25I", data[:100])
    width, height, big, depth, stride = fields[4], fields[5], fields[7] == 1, fields[11], fields[12]
    masks, colors = fields[14:17], fields[19]
    checked(width, height)
    if depth not in (24, 32):
        raise ValueError("only 24 and 32 bits a pixel")
    step = depth // 8
    raw = np.frombuffer(data, np.uint8, stride * height, head + 12 * colors).reshape(height, stride)[:, : width * step].reshape(height, width, step).astype(np.uint32)
    order = range(step) if big else range(step - 1, -1, -1)
    value = np.zeros((height, width), np.uint32)
    for k in order:
        value = value << 8 | raw[:, :, k]
    out = np.full((height, width, 4), 255, np.uint8)
    for c, mask in enumerate(masks):
        shift = (mask & -mask).bit_length() - 1
        out[:, :, c] = (value & mask) >> shift
    yield 0, width, height, out.tobytes()


def decode_png(data: bytes) -> Iterator[Frame]:
    """All colour types of 8 bits, gray and palettes of fewer, and 16 bits cut to 8; not interlaced."""
    at, parts, palette, clear = 8, [], b"", b""
    width = height = depth = color = interlaced = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    if interlaced:
        raise ValueError("interlaced")
    checked(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    row_bytes, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = zlib.decompress(b"".join(parts))
    rows = np.zeros((height, row_bytes), np.uint8)
    before = np.zeros(row_bytes, np.uint8)
    for y in range(height):
        kind, line = raw[y * (row_bytes + 1)], bytearray(raw[y * (row_bytes + 1) + 1 : (y + 1) * (row_bytes + 1)])
        if kind == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + before).astype(np.uint8).tobytes())
        elif kind:
            for x in range(row_bytes):
                left = line[x - step] if x >= step else 0
                up, corner = int(before[x]), int(before[x - step]) if x >= step else 0
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    add = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                line[x] = (line[x] + add) & 255
        rows[y] = before = np.frombuffer(bytes(line), np.uint8)
    if depth == 16:
        v = rows.reshape(height, width, channels, 2)[:, :, :, 0]
    elif depth == 8:
        v = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        v = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :width, None]
        if color == 0:
            v = v * 255 // ((1 << depth) - 1)
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        out = table[v[:, :, 0]]
    else:
        out[:, :, :3] = v[:, :, :1] if channels < 3 else v[:, :, :3]
        if channels in (2, 4):
            out[:, :, 3] = v[:, :, -1]
    yield 0, width, height, out.tobytes()


def _lzw(data: bytes, least: int, n: int) -> bytes:
    clear = 1 << least
    table: list[bytes] = []
    out, width, held, bits, last = bytearray(), least + 1, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear or not table:
                table, width, last = [bytes((k,)) for k in range(clear)] + [b"", b""], least + 1, None
                if code == clear:
                    continue
            if code == clear + 1:
                return bytes(out[:n])
            if last is None:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(last + entry[:1])
            else:
                entry = last + last[:1]
                table.append(entry)
            out += entry
            last = entry
            if len(table) > 4095:
                del table[4096:]
            if len(table) == 1 << width and width < 12:
                width += 1
    return bytes(out[:n])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Every frame as the whole canvas after it is drawn, with disposal and transparency."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    checked(width, height)
    at = 13
    colors = b""
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        colors, at = data[at : at + n], at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, clear, dispose = 0, -1, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                bits, wait, spot = struct.unpack("<BHB", data[at + 3 : at + 7])
                delay, dispose, clear = wait * 10, bits >> 2 & 7, spot if bits & 1 else -1
            _, at = blocks(at + 2)
            continue
        if data[at] != 0x2C:
            break
        x, y, w, h, bits = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        own = colors
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            own, at = data[at : at + n], at + n
        body, end = blocks(at + 1)
        pens = np.frombuffer(_lzw(body, data[at], w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        at = end
        if bits & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(pens)
            straight[order] = pens
            pens = straight
        table = np.zeros((256, 4), np.uint8)
        table[: len(own) // 3, :3] = np.frombuffer(own, np.uint8).reshape(-1, 3)
        table[:, 3] = 255
        held = canvas.copy()
        part = canvas[y : y + h, x : x + w]
        shown = pens[: part.shape[0], : part.shape[1]]
        drawn = shown != clear
        part[drawn] = table[shown[drawn]]
        yield delay, width, height, canvas.tobytes()
        if dispose == 2:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 3:
            canvas = held
        delay, clear, dispose = 0, -1, 0


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n != 128 else 1
    return bytes(out)


def _tiff_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out, width, held, bits, last = bytearray(), 9, 0, 0, None
    table: list[bytes] = []
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_tiff(data: bytes) -> Iterator[Frame]:
    """The first image of classic and 64-bit files in strips or tiles: bilevel, gray, palette, RGB and CMYK of
    up to 8 bits (16 cut to 8), plain, PackBits, LZW or deflated, with or without a predictor."""
    e = "<" if data[:2] == b"II" else ">"
    big = struct.unpack(e + "H", data[2:4])[0] == 43
    # Bytes of each field type.
    sizes = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q")}
    at = struct.unpack(e + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    count, at = (struct.unpack(e + "Q", data[at : at + 8])[0], at + 8) if big else (struct.unpack(e + "H", data[at : at + 2])[0], at + 2)
    tags: dict[int, tuple] = {}
    step, room = (20, 8) if big else (12, 4)
    for k in range(count):
        spot = at + k * step
        tag, kind = struct.unpack(e + "HH", data[spot : spot + 4])
        n = struct.unpack(e + ("Q" if big else "I"), data[spot + 4 : spot + 4 + room])[0]
        if kind not in sizes:
            continue
        size, letter = sizes[kind]
        where = spot + 4 + room
        if n * size > room:
            where = struct.unpack(e + ("Q" if big else "I"), data[where : where + room])[0]
        tags[tag] = struct.unpack(f"{e}{n}{letter}", data[where : where + n * size])
    width, height = tags[256][0], tags[257][0]
    checked(width, height)
    bits, samples, look = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags.get(262, (0,))[0]
    if tags.get(284, (1,))[0] != 1 and samples > 1:
        raise ValueError("separate planes")
    packed, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    unpack = {1: lambda b: b, 5: _tiff_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(packed)
    if unpack is None or bits not in (1, 2, 4, 8, 16):
        raise ValueError("unknown compression or depth")
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
    values = np.zeros((height, width, samples), np.int64)
    across = -(-width // tw)
    for k, (offset, length) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, height - y)
        row_bytes = (tw * samples * bits + 7) // 8
        raw = np.frombuffer(unpack(data[offset : offset + length])[: rows * row_bytes].ljust(rows * row_bytes, b"\0"), np.uint8).reshape(rows, row_bytes)
        if bits == 16:
            part = raw.reshape(rows, tw, samples, 2).astype(np.int64)
            part = part[..., 0] << 8 | part[..., 1] if e == ">" else part[..., 1] << 8 | part[..., 0]
        elif bits == 8:
            part = raw.reshape(rows, tw, samples).astype(np.int64)
        else:
            flat = np.unpackbits(raw, axis=1)[:, : tw * samples * bits].reshape(rows, tw, samples, bits)
            part = flat @ (1 << np.arange(bits - 1, -1, -1))
        if predictor == 2:
            part = np.cumsum(part, axis=1) & ((1 << bits) - 1)
        part = part[: height - y, : width - x]
        values[y : y + part.shape[0], x : x + part.shape[1]] = part
    top = (1 << bits) - 1
    out = np.full((height, width, 4), 255, np.uint8)
    scaled = values >> 8 if bits == 16 else values * 255 // top
    if look == 3:
        table = np.array(tags[320], np.int64).reshape(3, -1).T >> 8
        out[..., :3] = table[values[..., 0]]
    elif look in (0, 1):
        out[..., :3] = (255 - scaled[..., :1]) if look == 0 else scaled[..., :1]
        alpha = 1
    elif look == 5:
        out[..., :3] = (255 - scaled[..., :3]) * (255 - scaled[..., 3:4]) // 255
    elif look == 2:
        out[..., :3] = scaled[..., :3]
    else:
        raise ValueError("unknown colour space")
    alpha = {0: 1, 1: 1, 2: 3}.get(look)
    if alpha is not None and samples > alpha:
        out[..., 3] = scaled[..., alpha]
        if tags.get(338, (0,))[0] == 1:  # colours are multiplied by alpha
            a = np.maximum(out[..., 3:].astype(np.int64), 1)
            out[..., :3] = np.minimum(255, out[..., :3].astype(np.int64) * 255 // a)
    turned = tags.get(274, (1,))[0]
    out = {2: out[:, ::-1], 3: out[::-1, ::-1], 4: out[::-1], 5: out.transpose(1, 0, 2), 6: out.transpose(1, 0, 2)[:, ::-1], 7: out.transpose(1, 0, 2)[::-1, ::-1], 8: out.transpose(1, 0, 2)[::-1]}.get(turned, out)
    yield 0, out.shape[1], out.shape[0], np.ascontiguousarray(out).tobytes()


def jpeg_orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 (upright) if it has none."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            e = "<" if tiff[:2] == b"II" else ">"
            first = struct.unpack(e + "I", tiff[4:8])[0]
            for k in range(struct.unpack(e + "H", tiff[first : first + 2])[0]):
                tag, kind, n, value = struct.unpack(e + "HHIH", tiff[first + 2 + 12 * k : first + 12 + 12 * k])
                if tag == 274 and kind == 3 and n == 1 and 1 <= value <= 8:
                    return value
        at += 2 + size
    return 1


def oriented(files: DataFrame) -> DataFrame:
    """files (path, content) with orientation, by which resample.rotated turns a JPEG's pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(1).to_pylist():
                try:
                    found.append(jpeg_orientation(content or b""))
                except (struct.error, IndexError):
                    found.append(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["path", "orientation"])

    return files.select("path", "content").mapInArrow(run, "path string, orientation int")


#: Name, first bytes, where they stand, and decoder, in the order that formats are tried.
DECODERS: tuple[tuple[str, bytes, int, Callable[[bytes], Iterator[Frame]]], ...] = (
    ("GIF", b"GIF8", 0, decode_gif),
    ("PNG", b"\x89PNG\r\n\x1a\n", 0, decode_png),
    ("XWD", b"\0\0\0\7", 4, decode_xwd),
    ("QOI", b"qoif", 0, decode_qoi),
    ("TIFF", b"II*\0", 0, decode_tiff),
    ("TIFF", b"MM\0*", 0, decode_tiff),
    ("TIFF", b"II+\0", 0, decode_tiff),
    ("TIFF", b"MM\0+", 0, decode_tiff),
)
FRAMES = "path string, frame_no int, delay_ms int, width int, height int, pixel_type string, data binary, error string"


def has_magic(content: Column, at: int, magic: bytes) -> Column:
    return F.substring(content, at + 1, len(magic)) == F.lit(magic)


def bytes_at(content: Column, at: Column, n: Column, whole: bool = False) -> Column:
    """n bytes from a place on; fewer at the end, or, if they must be whole, null."""
    part = F.substring(content, at + 1, n)
    return F.when(F.length(part) == n, part) if whole else part


def format_of(content: Column, decoders=DECODERS) -> Column:
    """The first format whose bytes fit, or null."""
    return F.coalesce(*(F.when(has_magic(content, at, magic), name) for name, magic, at, _ in decoders))


def loader_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in dict.fromkeys(d[0] for d in DECODERS)], "name string").orderBy(F.lower("name"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files of up to 2 GiB - 2 bytes."""
    return spark.read.format("binaryFile").load(path).where("length <= 2147483646").select("path", "content")


def decode_frames(files: DataFrame, decoders=DECODERS) -> DataFrame:
    """One row a frame; a file that can't be decoded gives one row with the error.

    decoders: what DECODERS holds, and others of the same shape.  Frames come back one by one;
    frames before the place where a file breaks stand.
    """
    known = {name: decode for name, _, _, decode in decoders}
    shape = pa.schema([("path", pa.string()), ("frame_no", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixel_type", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, shape, strict=True)], schema=shape)
                failed = None if kind else "Unknown file format"
                try:
                    for k, (delay, w, h, data) in enumerate(known[kind](content) if kind else ()):
                        yield one(path, k, delay, w, h, "RGBA8_UNASSOCIATED", data, None)
                except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error) as e:
                    failed = str(e) or type(e).__name__
                if failed:
                    yield one(path, None, None, None, None, None, None, failed)

    return files.withColumn("kind", format_of(F.col("content"), decoders)).select("path", "content", "kind").mapInArrow(run, FRAMES)


def read_with_builtin(spark: SparkSession, path: str) -> DataFrame:
    """JPEG and other formats that the JVM decodes: one still frame a file, as BGR or BGRA."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    good = F.col("nChannels").isin(3, 4) & (F.col("width") > 0)
    kind = F.when(F.col("nChannels") == 4, "BGRA8_UNASSOCIATED").when(F.col("nChannels") == 3, "BGR8")
    shown = lambda c: F.when(good, c)
    return images.select(F.col("origin").alias("path"), shown(F.lit(0)).alias("frame_no"), shown(F.lit(0)).alias("delay_ms"), shown(F.col("width")).alias("width"), shown(F.col("height")).alias("height"), shown(kind).alias("pixel_type"), shown(F.col("data")).alias("data"), F.when(~good, "Unknown file format").alias("error"))
