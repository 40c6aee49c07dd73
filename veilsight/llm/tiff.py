"""TIFF columns: a reader that emits one row per page, and a small writer.

The reader walks the image directories of a file, decodes strips or tiles
(none, PackBits, LZW, deflate), undoes the horizontal and floating-point
predictors, and puts the image together in rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE, LZW, ADOBE_DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Tags of the format, by number.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = (
    256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339,
)
#: Field types: letter of struct and bytes.
FIELDS = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


#: Pages of more bytes are an error, as a few damaged bytes can name any size.
MAX_PAGE_BYTES = 1 << 31


def rows_too_long(rows: int, line: int) -> bool:
    return rows * line > MAX_PAGE_BYTES


class TiffError(ValueError):
    """What makes a file unreadable."""


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes, and what lies between as it stands, in parts of 128 at most."""
    out, start = bytearray(), 0

    def literals(a: int, b: int) -> None:
        for j in range(a, b, 128):
            part = data[j : min(j + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in RUNS.finditer(data):
        literals(start, run.start())
        out.extend((257 - (run.end() - run.start()), data[run.start()]))
        start = run.end()
    literals(start, len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, high bit first; widths grow one code early.  Stops once there are most bytes."""
    words = [bytes((i,)) for i in range(256)] + [b"", b""]
    out: list[bytes] = []
    table, width, held, have, last, made = words[:], 9, 0, 0, b"", 0
    for byte in data:
        held = (held << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 256:
            table, width, last = words[:], 9, b""
            continue
        if code == 257:
            break
        if not last:
            if code > 257:
                raise TiffError("LZW: the first code is not a byte")
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise TiffError("LZW: a code is not in the table")
        out.append(word)
        last = word
        made += len(word)
        if made >= most:
            break
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, have, width = bytearray(), 0, 0, 9
    fresh = {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, have
        held = (held << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    table, word = dict(fresh), b""
    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        word = data[i : i + 1]
        # the decoder is one entry behind, and stops at the same table size
        if len(table) + 2 == 4094:
            put(256)
            table, width = dict(fresh), 9
        elif len(table) + 2 > (1 << width) - 1:
            width += 1
    if word:
        put(table[word])
        # the decoder adds an entry for it too
        if len(table) + 3 > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    """Inflates to so many bytes at most."""
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


class Reader:
    def __init__(self, data: bytes):
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise TiffError("no TIFF header")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        if self.unpack("H", 2)[0] != 42:
            raise TiffError("no TIFF header")

    def unpack(self, kinds: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + kinds, self.data, at)
        except struct.error:
            raise TiffError("a field lies outside the file") from None

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.unpack("I", 4)[0], set()
        while at:
            if at in seen:
                raise TiffError("the directories run in a circle")
            seen.add(at)
            n = self.unpack("H", at)[0]
            tags = {}
            for i in range(n):
                tag, kind, count = self.unpack("HHI", at + 2 + 12 * i)
                if kind not in FIELDS or not count:
                    continue
                letters, size = FIELDS[kind]
                if count * size > len(self.data):
                    raise TiffError("a field lies outside the file")
                where = at + 10 + 12 * i
                if count * size > 4:
                    where = self.unpack("I", where)[0]
                tags[tag] = self.unpack(letters * count, where)
            yield tags
            at = self.unpack("I", at + 2 + 12 * n)[0]

    def pixels(self, tags: dict[int, tuple]) -> tuple[dict, bytes]:
        def one(tag: int, default: int) -> int:
            value = tags.get(tag, (default,))[0]
            if not isinstance(value, int) or value < 0:
                raise TiffError(f"tag {tag} is {value}")
            return value

        w, h, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
        kind, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
        about = {"width": w, "height": h, "samples": samples, "bits": bits, "compression": kind, "predictor": predictor}
        if bits not in (1, 4, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, ())):
            raise TiffError(f"samples of {tags.get(BITS)} bits")
        tiled = TILE_AT in tags
        pw, ph = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (w, min(one(STRIP_ROWS, h), h) or h)
        offsets, counts = (tags.get(TILE_AT, ()), tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIP_AT, ()), tags.get(STRIP_BYTES, ()))
        if not w or not h:
            return about, b""
        if not pw or not ph or len(offsets) != len(counts):
            raise TiffError("strips or tiles don't fit the image")
        planes, inner = (samples, 1) if planar == 2 else (1, samples)
        across, down = -(-w // pw), -(-h // ph)
        if len(offsets) < planes * across * down:
            raise TiffError("strips or tiles are missing")
        line, full = (pw * inner * bits + 7) // 8, (w * inner * bits + 7) // 8
        if tiled and pw * inner * bits % 8:
            raise TiffError("tiles that don't end on a byte")
        if not samples or planes * h * full > MAX_PAGE_BYTES or rows_too_long(ph, line):
            raise TiffError(f"a page of {w} x {h} with {samples} samples of {bits} bits")
        image = np.zeros((planes, h, full), np.uint8)
        for k in range(planes * across * down):
            plane, row, col = k // (across * down), k // across % down * ph, k % across * line
            rows = ph if tiled else min(ph, h - row)
            if not all(isinstance(x, int) and x >= 0 for x in (offsets[k], counts[k])):
                raise TiffError("strips or tiles lie nowhere")
            raw = self.data[offsets[k] : offsets[k] + counts[k]]
            if one(FILL, 1) == 2:
                raw = raw.translate(REVERSED)
            raw = self.decode(raw, kind, rows * line)
            if len(raw) < rows * line:
                raise TiffError("a strip or tile is too short")
            part = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
            part = self.unpredict(part, predictor, inner, bits)
            high, wide = min(rows, h - row), min(line, full - col)
            image[plane, row : row + high, col : col + wide] = part[:high, :wide]
        return about, image.tobytes()

    def decode(self, raw: bytes, kind: int, most: int) -> bytes:
        if kind == NONE:
            return raw
        if kind == LZW:
            return lzw_decode(raw, most)
        if kind in (ADOBE_DEFLATE, OLD_DEFLATE):
            return _inflate(raw, most)
        if kind == PACKBITS:
            return packbits_decode(raw)
        raise TiffError(f"compression {kind}")

    def unpredict(self, part: np.ndarray, predictor: int, inner: int, bits: int) -> np.ndarray:
        if predictor == 1:
            return part
        rows = part.shape[0]
        if part.shape[1] % (inner * max(1, bits // 8)):
            raise TiffError("lines that don't end on a sample")
        if predictor == 2 and bits in (8, 16, 32, 64):
            whole = part.view(f"{self.order}u{bits // 8}").reshape(rows, -1, inner)
            summed = np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("="))
            return summed.astype(whole.dtype).reshape(rows, -1).view(np.uint8)
        if predictor == 3 and bits in (16, 32, 64):
            step = bits // 8
            summed = np.cumsum(part.reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, step, -1)
            # bytes of like weight stand together, the highest first
            turned = summed.transpose(0, 2, 1)
            return np.ascontiguousarray(turned if self.order == ">" else turned[:, :, ::-1]).reshape(rows, -1)
        raise TiffError(f"predictor {predictor} for {bits} bits")


def read_pages(data: bytes | None) -> Iterator[dict]:
    """A dict a page; one with an error where the file ends being readable."""
    page = 0
    try:
        reader = Reader(data or b"")
        for tags in reader.directories():
            about, pixels = reader.pixels(tags)
            yield {"page": page, **about, "pixels": pixels, "error": None}
            page += 1
    except TiffError as e:
        yield {"page": page, "error": str(e)}


def write_page(payload: bytes, width: int = 64, kind: int = ADOBE_DEFLATE, predictor: int = 1, rows: int = 256, tiled: bool = False) -> bytes:
    """A little-endian file of one page of 8-bit grey samples, payload laid out in lines of width.

    Strips have so many rows, tiles are width x rows.
    """
    height = len(payload) // width
    image = np.frombuffer(payload, np.uint8).reshape(height, width)
    if tiled:
        image = np.vstack([image, np.zeros((-height % rows, width), np.uint8)])
    if predictor == 2:
        image = np.hstack([image[:, :1], np.diff(image, axis=1)])
    pack = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, ADOBE_DEFLATE: lambda x: zlib.compress(x, 1)}[kind]
    parts = [pack(image[i : i + rows].tobytes()) for i in range(0, image.shape[0], rows)]
    sizes = [len(p) for p in parts]
    starts = [8 + sum(sizes[:i]) for i in range(len(parts))] if len(parts) < 64 else (8 + np.concatenate([[0], np.cumsum(sizes[:-1])])).tolist()
    body = b"".join(parts)
    after = 8 + len(body) + (len(body) & 1)
    lists = b"" if len(parts) == 1 else struct.pack(f"<{2 * len(parts)}I", *starts, *sizes)
    listed = lambda k: (len(parts), after + 4 * k * len(parts)) if lists else (1, (starts, sizes)[k][0])
    tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, kind), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
    if tiled:
        tags += [(TILE_W, 4, 1, width), (TILE_H, 4, 1, rows), (TILE_AT, 4, *listed(0)), (TILE_BYTES, 4, *listed(1))]
    else:
        tags += [(STRIP_AT, 4, *listed(0)), (STRIP_ROWS, 4, 1, rows), (STRIP_BYTES, 4, *listed(1))]
    at = after + len(lists)
    entries = b"".join(struct.pack("<HHII", *t) for t in sorted(tags))
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) & 1) + lists + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, filled with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


#: Codecs that texts are stored by.
KINDS = (LZW, PACKBITS, ADOBE_DEFLATE)
#: Rows of 64 bytes in a strip or tile of a stored text.
STORED_ROWS = 256


def store(text: str | None) -> bytes:
    """The payload of a text as a TIFF of one page.

    A hash of the payload draws the codec, strips or tiles, and the predictor
    (PackBits has none), so that texts of every length meet every decoder and
    equal texts have equal files.
    """
    payload = payload_of(text)
    draw = zlib.crc32(payload)
    kind, tiled, predictor = KINDS[draw % 3], (draw >> 8) % 2 == 1, 1 + (draw >> 16) % 2
    rows = min(STORED_ROWS, -(-len(payload) // 64))
    return write_page(payload, kind=kind, predictor=1 if kind == PACKBITS else predictor, rows=-(-rows // 16) * 16 if tiled else rows, tiled=tiled)


PAGE = T.StructType(
    [T.StructField("page", T.IntegerType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("samples", "bits", "compression", "predictor")]
    + [T.StructField("pixels", T.BinaryType()), T.StructField("mean", T.DoubleType()), T.StructField("spread", T.DoubleType()), T.StructField("error", T.StringType())]
)
#: Rows leave the workers in batches of so many bytes of pixels, about.
BATCH_BYTES = 8 << 20


def store_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns of df other than the text, n_bytes of the text, and media: the text stored as a TIFF.  A null text is an empty one."""
    others = [c for c in df.columns if c not in (text, "n_bytes", "media")]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, text):
                texts = piece.column(text).to_pylist()
                arrays = [piece.column(c) for c in others]
                sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays, sizes, pa.array([store(t) for t in texts], pa.binary())], [*others, "n_bytes", "media"])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")).mapInArrow(run, schema)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """A row per page of the TIFF in column media: the columns of df other than those named like a page's, and the page's.

    A null, empty or broken file gives one row with page the number of good
    pages before and error the reason; pages before an error keep their rows.
    mean and spread are the mean and standard deviation of the pixel bytes.
    """
    others = [c for c in df.columns if c not in PAGE.names]
    schema = T.StructType([*[df.schema[c] for c in others], *PAGE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, media):
                rows, at = [], []
                for i, data in enumerate(piece.column(media).to_pylist()):
                    for page in read_pages(data):
                        if page.get("pixels"):
                            seen = np.frombuffer(page["pixels"], np.uint8)
                            n = np.bincount(seen, minlength=256)
                            mean = float(n @ np.arange(256)) / len(seen)
                            page |= {"mean": mean, "spread": float(np.sqrt(n @ (np.arange(256) - mean) ** 2 / len(seen)))}
                        rows.append(page)
                        at.append(i)
                kept = [piece.column(c).take(pa.array(at, pa.int32())) for c in others]
                kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.float64(), pa.float64(), pa.string()]
                made = [pa.array([r.get(n) for r in rows], k) for n, k in zip(PAGE.names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*others, *PAGE.names])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*others, media])]).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about BATCH_BYTES of the column."""
    step = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.column(column).nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
