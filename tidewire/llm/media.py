"""Media columns: what bytes are, by signature, and what media they carry inside.

An Aho-Corasick automaton finds all magic bytes of a value in one pass. A format's
validator then reads the structure that its signature announces and gives the length
that the structure accounts for; what doesn't validate is no media. A value's type is
that of a valid signature at its start, whatever type it was declared with; valid
signatures further in are embedded media and can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Value(bytes):
    """Bytes that find each mark that validators look for once, however many signatures they have."""

    def places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("marks", {})
        if mark not in known:
            known[mark], at = [], self.find(mark)
            while at >= 0:
                known[mark].append(at)
                at = self.find(mark, at + 1)
        return known[mark]

    def after(self, mark: bytes, at: int) -> list[int]:
        """Places of a mark from `at` on."""
        found = self.places(mark)
        return found[bisect_left(found, at) :]

    def between(self, mark: bytes, start: int, end: int) -> bool:
        found = self.places(mark)
        i = bisect_left(found, start)
        return i < len(found) and found[i] + len(mark) <= end


def png(data: bytes, at: int) -> int:
    """Length of a PNG file at `at`, 0 if none: chunks with right checksums up to IEND."""
    place, seen = at + 8, False
    while place + 12 <= len(data):
        size = int.from_bytes(data[place : place + 4], "big")
        kind, end = data[place + 4 : place + 8], place + 12 + size
        if end > len(data) or zlib.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return 0
        if not seen and (kind != b"IHDR" or size != 13):
            return 0
        seen, place = True, end
        if kind == b"IEND":
            return end - at
    return 0


def jpeg(data: bytes, at: int) -> int:
    """Length of a JPEG file: segments from SOI to EOI, with a frame and a scan between."""
    place, frame = at + 2, False
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind, size = data[place + 1], int.from_bytes(data[place + 2 : place + 4], "big")
        if kind < 0xC0 or size < 2:
            return 0
        frame |= kind in (0xC0, 0xC1, 0xC2, 0xC3)
        place += 2 + size
        if kind == 0xDA:
            while (place := data.find(b"\xff", place)) >= 0 and place + 1 < len(data):
                if data[place + 1] == 0xD9:
                    return place + 2 - at if frame else 0
                if data[place + 1] != 0 and not 0xD0 <= data[place + 1] <= 0xD7 and data[place + 1] != 0xFF:
                    break
                place += 1 if data[place + 1] == 0xFF else 2
            if place < 0:
                return 0
    return 0


def gif(data: bytes, at: int) -> int:
    """Length of a GIF file: blocks from the screen descriptor to the trailer."""
    if at + 13 > len(data):
        return 0
    flags = data[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1

    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 < len(data):
            flags = data[place + 9]
            place = blocks(place + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return 0
    return 0


def bmp(data: bytes, at: int) -> int:
    """Length of an uncompressed BMP file: header, palette and rows account for its size."""
    if at + 54 > len(data):
        return 0
    size, reserved, offset, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    if reserved or header < 40 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return 0
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    fits = 14 + header <= offset and offset + rows <= size and at + size <= len(data)
    return size if fits else 0


def riff(kind: bytes) -> Callable[[bytes, int], int]:
    def length(data: bytes, at: int) -> int:
        """Length of a RIFF file of one kind: its chunks fill its size."""
        if at + 12 > len(data) or data[at + 8 : at + 12] != kind:
            return 0
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        place, chunks = at + 12, 0
        while place + 8 <= min(end, len(data)):
            size = int.from_bytes(data[place + 4 : place + 8], "little")
            place, chunks = place + 8 + size + size % 2, chunks + 1
        return end - at if chunks and place == end <= len(data) else 0

    return length


def pdf(data: Value, at: int) -> int:
    """Length of a PDF file: its first %%EOF, if a startxref stands before that."""
    if not data[at + 5 : at + 6].isdigit():
        return 0
    found = data.places(b"%%EOF")
    i = bisect_left(found, at)
    return found[i] + 5 - at if i < len(found) and data.between(b"startxref", at, found[i]) else 0


def archive(data: Value, at: int) -> int:
    """Length of a ZIP file: its end record's directory lies where it says, and starts at an entry."""
    for end in data.after(b"PK\x05\x06", at):
        if end + 22 > len(data):
            break
        size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
        if at + offset + size == end and data[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + comment <= len(data):
            return end + 22 + comment - at
    return 0


def gzip(data: bytes, at: int) -> int:
    """Length of a gzip member that inflates to its end with the right checksum."""
    inflate = zlib.decompressobj(31)
    try:
        for place in range(at, len(data), 1 << 16):
            inflate.decompress(data[place : place + (1 << 16)])
            if inflate.eof:
                return min(place + (1 << 16), len(data)) - len(inflate.unused_data) - at
    except zlib.error:
        pass
    return 0


def flac(data: bytes, at: int) -> int:
    """Length of a FLAC stream's metadata; its frames run to the value's end."""
    place = at + 4
    if data[place : place + 1] not in (b"\x00", b"\x80"):
        return 0
    while place + 4 <= len(data):
        last, place = data[place] & 0x80, place + 4 + int.from_bytes(data[place + 1 : place + 4], "big")
        if last:
            return len(data) - at if place <= len(data) else 0
    return 0


#: Magic bytes, type and validator of each format. Fixed values.
FORMATS: tuple[tuple[bytes, str, Callable[[Value, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"BM", "image/bmp", bmp),
    (b"RIFF", "audio/wav", riff(b"WAVE")),
    (b"RIFF", "image/webp", riff(b"WEBP")),
    (b"%PDF-", "application/pdf", pdf),
    (b"PK\x03\x04", "application/zip", archive),
    (b"\x1f\x8b\x08", "application/gzip", gzip),
    (b"fLaC", "audio/flac", flac),
)


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, _, _ in FORMATS):
        out.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
    out.make_automaton()
    return out


def find(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the valid media in `data`, those inside others too, by start."""
    value, out = Value(data), []
    for last, (size, formats) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        out += [(kind, at, n) for kind, check in formats if (n := check(value, at))]
    return out


def carve(data: bytes, start: int, length: int) -> bytes:
    """The media that `find` found at `start`."""
    return data[start : start + length]


def sniff(
    frame: DataFrame, id_col: str = "id", data_col: str = "data", type_col: str | None = None
) -> DataFrame:
    """(id, declared, type, size, embedded) of each row of `frame`.

    `type` is that of valid media at the value's start; where there is none, text/plain
    for UTF-8 without control characters, else application/octet-stream. `embedded` is
    an array of (type, start, length, sha256) of media that start further in. A null or
    empty value is of size 0, has a null type and carries nothing. Null ids and repeated
    rows stay, an empty table gives no rows, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, sizes, inside = [], [], []
            for value in batch.column(2):
                data = value.as_py() or b""
                media = find(data)
                own = next((kind for kind, at, _ in media if at == 0), None)
                types.append(own or plain(data))
                sizes.append(len(data))
                inside.append(
                    [
                        {"type": kind, "start": at, "length": n, "sha256": hashlib.sha256(carve(data, at, n)).hexdigest()}
                        for kind, at, n in media
                        if at
                    ]
                )
            columns = [batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(sizes, pa.int64()), pa.array(inside, embedded)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "declared", "type", "size", "embedded"])

    embedded = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
    declared = F.lit(None).cast("string") if type_col is None else F.col(type_col).cast("string")
    rows = frame.select(F.col(id_col).alias("id"), declared.alias("declared"), F.col(data_col).cast("binary").alias("data"))
    kind = rows.schema["id"].dataType.simpleString()
    inner = "array<struct<type:string,start:bigint,length:bigint,sha256:string>>"
    return rows.mapInArrow(run, f"id {kind}, declared string, type string, size long, embedded {inner}")


def plain(data: bytes) -> str | None:
    if not data:
        return None
    try:
        data.decode()
    except UnicodeDecodeError:
        return "application/octet-stream"
    return "application/octet-stream" if any(c in data for c in b"\x00\x01\x02\x03\x04\x05\x06\x07\x0e") else "text/plain"


#: What stored files are declared to be.
DECLARED = "application/octet-stream"
#: Width of stored bitmaps in samples; rows of this width need no filling up.
WIDTH = 192


def bitmap(samples: bytes) -> bytes:
    """8-bit samples, a multiple of `WIDTH`, as a grey bitmap file, first row on top."""
    height = len(samples) // WIDTH
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    offset = 54 + len(grey)
    head = struct.pack("<2sIII", b"BM", offset + len(samples), 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, WIDTH, -height, 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey + samples


def bitmap_samples(data: bytes) -> bytes:
    """The samples of a valid bitmap file as `bitmap` makes them."""
    offset, _, width, height = struct.unpack_from("<IIii", data, 10)
    return data[offset : offset + width * abs(height)]


def stored(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a bitmap, found again by signature, and read back.

    A text's UTF-8 bytes (none of a null text) are filled up with spaces to a positive
    multiple of `WIDTH`. The file is declared to be of no known type; its validated
    signature corrects that and gives its length, and the samples are read from what
    was found. Returns (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, declared, type, embedded): `feature` tells the
    bitmap's shape and depth, the mean sample, and the number of media inside; `type`
    corrects `declared`, and `embedded` counts media that the text itself carries. Equal
    texts give equal values. Null ids and repeated rows stay, an empty table gives no
    rows, texts are stored whole, however long; other columns are left out.
    """

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        file = bitmap(raw + b" " * (WIDTH - len(raw) if not raw else -len(raw) % WIDTH))
        media = find(file)
        kind, start, length = next(m for m in media if m[1] == 0)
        payload = bitmap_samples(carve(file, start, length))
        mean = sum(payload) // len(payload)
        feature = f"{kind};{WIDTH}x{len(payload) // WIDTH}x8;mean={mean};inside={len(media) - 1}"
        return (
            *(len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])),
            *(len(file), hashlib.sha256(file).hexdigest(), feature, DECLARED, kind, len(media) - 1),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(one(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * len(names)
            columns = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "type", "embedded"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = ["string" if k == pa.string() else "long" for k in kinds]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")
