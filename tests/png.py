"""Small PNG files for tests, written with the standard library."""

import struct
import zlib

import numpy as np


def write_png(path, bgr: np.ndarray) -> None:
    h, w = bgr.shape[:2]
    rgb = bgr[:, :, ::-1].astype("uint8")
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
