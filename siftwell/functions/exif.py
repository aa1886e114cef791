"""EXIF fields of JPEG, PNG, WebP and TIFF bytes: a bounded walk of tag directories in either byte order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_FIELDS, MOST_VALUES, MOST_BLOB, MOST_DIRECTORIES = 512, 64, 32, 16

# Tags by number, in the main and the camera's directories and in that of positions; types by number with struct letter and size.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution",
    0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram",
    0x8827: "PhotographicSensitivity", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash",
    0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA405: "FocalLengthIn35mmFilm", 0xA434: "LensModel",
}
GPS_TAGS = {0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude", 0x0005: "GPSAltitudeRef", 0x0006: "GPSAltitude", 0x001D: "GPSDateStamp"}
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("u", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825


def block(data: bytes) -> bytes:
    """The TIFF block of a file's EXIF data, empty if there is none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"EXIF":
                body = data[at + 8 : at + 8 + size]
                return body[6:] if body[:6] == b"Exif\0\0" else body
            at += 8 + size + size % 2
    return b""


def _told(kind: str, raw: bytes, order: str, n: int) -> str:
    """A value as text: strings without their zero bytes, blobs as hex, fractions as they are."""
    if kind == "s":
        return ", ".join(p.decode("utf-8", "replace") for p in raw.split(b"\0") if p)
    if kind == "u":
        return raw[:MOST_BLOB].hex().upper() + (f"… ({n}B)" if n > MOST_BLOB else "")
    values = struct.unpack(f"{order}{len(raw) // struct.calcsize('=' + kind) * len(kind)}{kind[0]}", raw)
    if len(kind) == 2:
        return ", ".join(f"{a}/{b}" for a, b in zip(values[::2], values[1::2], strict=True))
    return ", ".join(f"{v:g}" if isinstance(v, float) else str(v) for v in values)


def fields(data: bytes) -> dict[str, str]:
    """Field names (`exif:Make`) with their values as text. Directories are visited once each and fields that point outside the block are left out, so hostile offsets end."""
    tiff, out = block(data), {}
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return out
    todo, seen = [(struct.unpack(order + "I", tiff[4:8])[0], TAGS)], set()
    while todo and len(seen) < MOST_DIRECTORIES and len(out) < MOST_FIELDS:
        at, names = todo.pop(0)
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for tag, kind, size, n, raw, number in _entries(tiff, at, order):
            if tag in (EXIF_POINTER, GPS_POINTER) and number is not None:
                todo.append((number, TAGS if tag == EXIF_POINTER else GPS_TAGS))
            elif tag in names and len(out) < MOST_FIELDS:
                out.setdefault(f"exif:{names[tag]}", _told(kind, raw, order, n))
    return out


def _entries(tiff: bytes, at: int, order: str) -> Iterator[tuple[int, str, int, int, bytes, int | None]]:
    count = struct.unpack(order + "H", tiff[at : at + 2])[0]
    for k in range(min(count, MOST_FIELDS)):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            return
        tag, code, n = struct.unpack(order + "HHI", entry[:8])
        if code not in TYPES:
            continue
        kind, size = TYPES[code]
        kept = n if kind in "su" else min(n, MOST_VALUES)
        begin = 0 if n * size <= 4 else struct.unpack(order + "I", entry[8:])[0]
        source = entry[8:] if n * size <= 4 else tiff
        if begin + n * size > len(source):
            continue
        raw = source[begin : begin + min(kept * size, 1 << 16)]
        yield tag, kind, size, n, raw, struct.unpack(order + "I", entry[8:])[0] if code == 4 and n == 1 else None


def exif(content: Column) -> Column:
    """map<string, string> of the EXIF fields of an image's bytes; empty without any, null for null."""

    @F.arrow_udf("map<string, string>")
    def compute(found: pa.Array) -> pa.Array:
        return pa.array([None if b.as_py() is None else list(fields(b.as_py()).items()) for b in found], pa.map_(pa.string(), pa.string()))

    return compute(content)
