"""Sizes of JPEG and PNG images from their headers."""

from __future__ import annotations

import struct

from pointloom.errors import UnsupportedFormat


def image_size(head: bytes) -> tuple[int, int]:
    """Width and height; other formats, or a header that is cut off, are an error."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                at += 1
                continue
            kind = head[at + 1]
            if kind == 0xFF:
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            elif kind == 0x01 or 0xD0 <= kind <= 0xD9:
                at += 2
            else:
                at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    raise UnsupportedFormat("neither a JPEG nor a PNG image")
