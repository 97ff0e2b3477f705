"""A PNG writer for RGBA rows (standard library only)."""

from __future__ import annotations

import struct
import zlib


def png(rgba: bytes, width: int, height: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    row = 4 * width
    raw = b"".join(b"\0" + rgba[i * row : (i + 1) * row] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
