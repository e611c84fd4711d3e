"""Sizes of pictures in pixels, read from the first bytes of PNG, JPEG, GIF and BMP files."""

from __future__ import annotations

import struct


def header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height), or None for other files and cut ones."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return ("PNG", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return "BMP", width, abs(height)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except struct.error:
        pass
    return None


def _jpeg(data: bytes) -> tuple[str, int, int] | None:
    """Passes over segments up to the frame header; its markers are C0 to CF but for the tables C4, C8 and CC."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # padding before a marker
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:  # markers without a body
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "JPEG", width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None
