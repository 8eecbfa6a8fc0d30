"""Tiny media files, built from the TIFF and container layouts."""

import struct


def tiff(original=None, make=None, model=None, gps=None):
    def text(s):
        return s.encode() + b"\0"

    heap, top, exif, place = b"", [], [], []
    size = 8 + (2 + 12 * 4 + 4) + (2 + 12 * 1 + 4) + (2 + 12 * 4 + 4)

    def put(data):
        nonlocal heap
        at = size + len(heap)
        heap += data + b"\0" * (len(data) % 2)
        return at

    def ascii_entry(tag, s):
        data = text(s)
        return struct.pack("<HHI", tag, 2, len(data)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", put(data)))

    if make:
        top.append(ascii_entry(0x010F, make))
    if model:
        top.append(ascii_entry(0x0110, model))
    if original:
        exif.append(ascii_entry(0x9003, original))
    if gps:
        for base, value, refs in ((1, gps[0], "NS"), (3, gps[1], "EW")):
            v = abs(value)
            d, m = int(v), int(v * 60) % 60
            s = round((v - d - m / 60) * 3600 * 100)
            place.append(ascii_entry(base, refs[value < 0]))
            place.append(struct.pack("<HHII", base + 1, 5, 3, put(struct.pack("<6I", d, 1, m, 1, s, 100))))
    at_exif, at_gps = 8 + 2 + 12 * 4 + 4, 8 + (2 + 12 * 4 + 4) + (2 + 12 + 4)
    top.append(struct.pack("<HHII", 0x8769, 4, 1, at_exif))
    if place:
        top.append(struct.pack("<HHII", 0x8825, 4, 1, at_gps))
    block = lambda entries, room: (struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4).ljust(2 + 12 * room + 4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + block(top, 4) + block(exif, 1) + block(place, 4) + heap


def jpeg(**facts):
    body = b"Exif\0\0" + tiff(**facts) if facts else b""
    app = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body if body else b""
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0"[:2] + app + b"\xff\xda\0\2" + b"pixels" + b"\xff\xd9"


def webp(**facts):
    body = tiff(**facts)
    chunk = b"EXIF" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def png(**facts):
    body = tiff(**facts)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(body)) + b"eXIf" + body + b"crc!"


def heic(brand=b"heic", **facts):
    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    item = b"\0\0\0\6Exif\0\0" + tiff(**facts)
    head = box(b"ftyp", brand + b"\0\0\0\0mif1")
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + infe)

    def meta(at):
        iloc = box(b"iloc", b"\0\0\0\0" + b"\x44\0" + struct.pack(">HHHHII", 1, 1, 0, 1, at, len(item)))
        return box(b"meta", b"\0\0\0\0" + iinf + iloc)

    return head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", item)
