"""EXIF facts from JPEG, PNG, WebP, HEIF/AVIF, and TIFF-based files.

Parsing is tolerant: whatever a damaged file still yields is kept, and nothing raises.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from dataclasses import dataclass
from typing import BinaryIO

#: Tag numbers.
MAKE, MODEL, DATETIME, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825
ORIGINAL, DIGITIZED, OFFSET_ORIGINAL = 0x9003, 0x9004, 0x9011
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MAX_ENTRIES = 4096


class View:
    """Bytes of a seekable file, read where they are asked for."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, os.SEEK_END)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            return self[key : key + 1][0]
        start, stop, _ = key.indices(self.size)
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def startswith(self, mark: bytes) -> bool:
        return self[: len(mark)] == mark


Data = bytes | View


def _unpack(form: str, data: Data, at: int) -> int:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])[0]


@dataclass
class Facts:
    original: str | None = None
    create: str | None = None
    modify: str | None = None
    offset: str | None = None
    make: str | None = None
    model: str | None = None
    gps: tuple[float, float] | None = None


def clean(raw: bytes) -> str | None:
    """Text of an ASCII tag: parts joined by spaces, NULs and outer spaces off; empty is null."""
    parts = [p for p in raw.rstrip(b"\0").split(b"\0")]
    text = b" ".join(parts).decode("utf-8", "replace").strip().strip("\0").strip()
    return text or None


class _Tiff:
    def __init__(self, data: Data):
        self.data = data
        mark = data[:2]
        if mark not in (b"II", b"MM"):
            raise ValueError("no TIFF header")
        self.order = "<" if mark == b"II" else ">"

    def num(self, form: str, at: int) -> int:
        return _unpack(self.order + form, self.data, at)

    def directory(self, at: int) -> dict[int, tuple[int, int, int]]:
        """Entries of an IFD, as far as they can be read: tag to (type, count, place of value)."""
        out: dict[int, tuple[int, int, int]] = {}
        try:
            for i in range(min(self.num("H", at), MAX_ENTRIES)):
                entry = at + 2 + 12 * i
                tag, kind, count = self.num("H", entry), self.num("H", entry + 2), self.num("I", entry + 4)
                size = _SIZES.get(kind, 0) * count
                out.setdefault(tag, (kind, count, entry + 8 if size <= 4 else self.num("I", entry + 8)))
        except struct.error:
            pass
        return out

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        if not entry or entry[0] != 2 or entry[2] + entry[1] > len(self.data):
            return None
        return clean(self.data[entry[2] : entry[2] + entry[1]])

    def rationals(self, entry: tuple[int, int, int] | None) -> list[tuple[int, int]]:
        if not entry or entry[0] not in (5, 10):
            return []
        form = "I" if entry[0] == 5 else "i"
        try:
            return [(self.num(form, entry[2] + 8 * i), self.num(form, entry[2] + 8 * i + 4)) for i in range(min(entry[1], 8))]
        except struct.error:
            return []


def degrees(parts: list[tuple[int, int]], ref: str | None) -> float | None:
    if len(parts) < 3 or any(den == 0 for _, den in parts[:3]):
        return None
    value = sum(num / den / 60**i for i, (num, den) in enumerate(parts[:3]))
    return -value if ref and ref[:1].upper() in ("S", "W") else value


def _pointer(tiff: _Tiff, entry: tuple[int, int, int] | None) -> int | None:
    try:
        return tiff.num("I", entry[2]) if entry and entry[0] == 4 else None
    except struct.error:
        return None


def read_tiff(data: Data) -> Facts:
    facts = Facts()
    try:
        tiff = _Tiff(data)
        top = tiff.directory(tiff.num("I", 4))
    except (ValueError, struct.error):
        return facts
    facts.make, facts.model, facts.modify = (tiff.text(top.get(t)) for t in (MAKE, MODEL, DATETIME))
    if (at := _pointer(tiff, top.get(EXIF_IFD))) is not None:
        exif = tiff.directory(at)
        facts.original, facts.create, facts.offset = (tiff.text(exif.get(t)) for t in (ORIGINAL, DIGITIZED, OFFSET_ORIGINAL))
    if (at := _pointer(tiff, top.get(GPS_IFD))) is not None:
        gps = tiff.directory(at)
        lat = degrees(tiff.rationals(gps.get(LAT)), tiff.text(gps.get(LAT_REF)))
        lon = degrees(tiff.rationals(gps.get(LON)), tiff.text(gps.get(LON_REF)))
        if lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180 and (lat, lon) != (0.0, 0.0):
            facts.gps = (lat, lon)
    return facts


def _bare(block: Data) -> Data:
    return block[6:] if block.startswith(b"Exif\0\0") else block


def _jpeg(data: Data) -> bytes | None:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], _unpack(">H", data, at + 2)
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if kind == 0xDA:
            return None
        at += 2 + size
    return None


def _chunks(data: Data, at: int, form: str, name_first: bool, extra: int, align: int, wanted: bytes) -> bytes | None:
    """Body of the first chunk of a name in a PNG or RIFF sequence."""
    while at + 8 <= len(data):
        head = data[at : at + 8]
        name, size = (head[:4], struct.unpack(form, head[4:])[0]) if name_first else (head[4:], struct.unpack(form, head[:4])[0])
        if name == wanted:
            return data[at + 8 : at + 8 + size]
        at += 8 + size + extra
        at += at % 2 if align == 2 else 0
    return None


def _boxes(data: Data, at: int, end: int):
    while at + 8 <= end:
        size, name, head = _unpack(">I", data, at), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = _unpack(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def _heif(data: Data) -> bytes | None:
    """Item of type Exif, found by way of ``meta``, ``iinf`` and ``iloc``."""
    meta = next((b for b in _boxes(data, 0, len(data)) if b[0] == b"meta"), None)
    if not meta:
        return None
    inner = {name: (a, b) for name, a, b in _boxes(data, meta[1] + 4, meta[2])}
    if b"iinf" not in inner or b"iloc" not in inner:
        return None
    a, b = inner[b"iinf"]
    item = None
    for name, x, _ in _boxes(data, a + (6 if data[a] == 0 else 8), b):
        if name == b"infe" and data[x] >= 2:
            wide = data[x] >= 3
            kind = x + 4 + (4 if wide else 2) + 2
            if data[kind : kind + 4] == b"Exif":
                item = _unpack(">I" if wide else ">H", data, x + 4)
    if item is None:
        return None
    a, _ = inner[b"iloc"]
    version, sizes = data[a], _unpack(">H", data, a + 4)
    offset_size, length_size, base_size, index_size = (sizes >> s & 15 for s in (12, 8, 4, 0))
    at = a + 6
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    wide = 4 if version == 2 else 2
    count = number(at, wide)
    at += wide
    for _ in range(count):
        found = number(at, wide)
        at += wide + (2 if version in (1, 2) else 0) + 2
        base = number(at, base_size)
        at += base_size
        extents = number(at, 2)
        at += 2
        body = b""
        for _ in range(extents):
            at += index_size if version in (1, 2) else 0
            start, size = number(at, offset_size), number(at + offset_size, length_size)
            at += offset_size + length_size
            if found == item:
                body += data[base + start : base + start + size]
        if found == item:
            # four bytes say where the TIFF header begins
            return _bare(body[4 + struct.unpack_from(">I", body, 0)[0] :]) if len(body) > 8 else None
    return None


_CONTAINERS: list[tuple[Callable[[Data], bool], Callable[[Data], Data | None]]] = [
    (lambda d: d.startswith(b"\xff\xd8"), _jpeg),
    (lambda d: d.startswith(b"\x89PNG\r\n\x1a\n"), lambda d: _chunks(d, 8, ">I", False, 4, 1, b"eXIf")),
    (lambda d: d[:4] == b"RIFF" and d[8:12] == b"WEBP", lambda d: _chunks(d, 12, "<I", True, 0, 2, b"EXIF")),
    (lambda d: d[4:8] == b"ftyp", _heif),
    (lambda d: d[:2] in (b"II", b"MM"), lambda d: d),
]


def read(data: Data) -> Facts:
    """Facts of a file's bytes or view; a container that is unknown or damaged has none."""
    for fits, block in _CONTAINERS:
        if fits(data):
            try:
                found = block(data)
            except (struct.error, IndexError, ValueError):
                return Facts()
            return read_tiff(_bare(found)) if found else Facts()
    return Facts()
