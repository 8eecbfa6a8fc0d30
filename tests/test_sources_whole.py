"""Files whose EXIF block lies behind more than a mebibyte of other data."""

import io
import struct

import pytest

from tests.mediafiles import heic, jpeg, png, tiff, webp

from shelf.options import Options
from shelf.sources import exif, tree

WHEN = "2021:06:07 10:11:12"
FAR = 3 << 20


def _far_tiff() -> bytes:
    """IFD 0 and its values at the end of the file."""
    make, date = b"Canon\0", WHEN.encode() + b"\0"
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, len(make), FAR + 100) + struct.pack("<HHII", 0x8769, 4, 1, FAR + 50) + b"\0" * 4
    sub = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(date), FAR + 120) + b"\0" * 4
    return (b"II*\0" + struct.pack("<I", FAR)).ljust(FAR, b"\1") + ifd.ljust(50, b"\0") + sub.ljust(50, b"\0") + make.ljust(20, b"\0") + date


def _far_files() -> dict[str, bytes]:
    facts = {"original": WHEN, "make": "Canon"}
    near = webp(**facts)
    image = b"VP8 " + struct.pack("<I", FAR) + b"\1" * FAR
    pixels = struct.pack(">I", FAR) + b"IDAT" + b"\1" * FAR + b"crc!"
    whole = heic(**facts)
    at = whole.index(b"\0\0\0\6Exif")
    fill = struct.pack(">I", FAR) + b"free" + b"\1" * (FAR - 8)
    old, new = (struct.pack(">II", n, len(whole) - at) for n in (at, at + FAR))
    mdat = at - 8
    return {
        "a.webp": near[:4] + struct.pack("<I", len(near) + len(image) - 8) + b"WEBP" + image + near[12:],
        "b.png": png(**facts)[:8] + pixels + png(**facts)[8:],
        "c.tif": _far_tiff(),
        "d.heic": whole[:mdat].replace(old, new) + fill + whole[mdat:],
        "f.jpg": jpeg(**facts)[:2] + (b"\xff\xe2" + struct.pack(">H", 60_002) + b"\1" * 60_000) * 30 + jpeg(**facts)[2:],
    }


def test_facts_of_large_files(spark, tmp_path):
    for name, data in _far_files().items():
        (tmp_path / name).write_bytes(data)
    records, failures = tree.scan(spark, Options(source=str(tmp_path), now_year=2030))
    got = {r["rel_path"]: (r["date_source"], r["camera_make"]) for r in records.collect()}
    assert failures.count() == 0
    assert got == {n: ("exif-datetime-original", "Canon") for n in _far_files()}


@pytest.mark.parametrize("made", [jpeg, webp, png, heic, tiff])
def test_view_reads_like_bytes(made):
    whole = made(original=WHEN, make="Canon", model="EOS R5", gps=(-33.9249, -18.4241))
    for cut in range(len(whole) + 1):
        assert exif.read(exif.View(io.BytesIO(whole[:cut]))) == exif.read(whole[:cut])
