"""TIFF images of one or more bands as arrays, and arrays as TIFF, by NumPy and the standard library alone.

Read: strips or tiles, chunky bands, no compression, LZW or deflate, with or without horizontal
prediction, integers of 8 to 32 bits and floats. Written: one band in deflated strips, with the place of
the grid on the map if it is given.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}


@dataclass
class Place:
    """Where the upper left corner of the first pixel lies, how wide and high pixels are, and the code of the projection (0: none)."""

    x: float
    y: float
    width: float
    height: float
    epsg: int = 0


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bit on, one bit longer one code early."""
    out = bytearray()
    table: list[bytes] = []
    bits, held, width, last = 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                piece = table[code]
            elif last and code == len(table):
                piece = last + last[:1]
            else:
                raise ValueError("broken LZW data")
            out += piece
            if last:
                table.append(last + piece[:1])
                width = 9 + sum(len(table) >= n for n in (511, 1023, 2047))
            last = piece
    return bytes(out)


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags) of a file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF file")
    big = struct.unpack(order + "H", data[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), data[at : at + (8 if big else 2)])[0]
    at += 8 if big else 2
    step, room = (20, 8) if big else (12, 4)
    tags = {}
    for k in range(n):
        entry = data[at + k * step : at + (k + 1) * step]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + room])[0]
        size = _SIZE.get(kind, 1) * count
        value = entry[4 + room :]
        if size > room:
            start = struct.unpack(order + ("Q" if big else "I"), value)[0]
            value = data[start : start + size]
        tags[tag] = struct.unpack(order + _CODE[kind] * count, value[:size]) if kind in _CODE else (value[:size],)
    return order, tags


def read(data: bytes) -> tuple[np.ndarray, Place | None]:
    """(rows x columns, or rows x columns x bands; place) of a file's first image."""
    order, tags = tags_of(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    cols, rows, bands = one(256, 0), one(257, 0), one(277, 1)
    bits, kind, compression, predictor = one(258, 1), one(339, 1), one(259, 1), one(317, 1)
    if bits not in (8, 16, 32, 64) or compression not in (1, 5, 8, 32946) or one(284, 1) != 1 or predictor not in (1, 2):
        raise ValueError(f"a TIFF of {bits} bits, compression {compression}, layout {one(284, 1)}, predictor {predictor} isn't read")
    dtype = np.dtype(f"{order}{'f' if kind == 3 else 'i' if kind == 2 else 'u'}{bits // 8}")
    tiled = 322 in tags
    wide, high = (one(322, cols), one(323, rows)) if tiled else (cols, min(one(278, rows), rows))
    offsets, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    out = np.zeros((rows, cols, bands), dtype.newbyteorder("="))
    across = -(-cols // wide)
    for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[start : start + size]
        raw = raw if compression == 1 else lzw(raw) if compression == 5 else zlib.decompress(raw)
        r, c = k // across * high, k % across * wide
        lines = high if tiled else min(high, rows - r)
        block = np.frombuffer(raw, dtype, lines * wide * bands).reshape(lines, wide, bands)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[r : r + high, c : c + wide] = block[: rows - r, : cols - c]
    place = None
    if 33550 in tags and 33922 in tags:
        i, j, _, x, y, _ = tags[33922][:6]
        width, height = tags[33550][:2]
        keys = tags.get(34735, ())
        epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (3072, 2048)), 0)
        place = Place(x - i * width, y + j * height, width, height, epsg)
    return (out[:, :, 0] if bands == 1 else out), place


def write(image: np.ndarray, place: Place | None = None, strip: int = 64) -> bytes:
    """A file of one band."""
    image = np.ascontiguousarray(image, image.dtype.newbyteorder("<"))
    rows, cols = image.shape
    strips = [zlib.compress(image[r : r + strip].tobytes()) for r in range(0, rows, strip)]
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries: list[tuple[int, int, list]] = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [image.dtype.itemsize * 8]), (259, 3, [8]), (262, 3, [1]), (277, 3, [1]), (278, 4, [strip]), (279, 4, [len(s) for s in strips]), (339, 3, [kind])]
    offsets = list(np.cumsum([8, *map(len, strips)])[:-1].tolist())
    entries.append((273, 4, offsets))
    if place is not None:
        model = 2 if place.epsg == 4326 else 1
        entries += [(33550, 12, [place.width, place.height, 0.0]), (33922, 12, [0.0, 0.0, 0.0, place.x, place.y, 0.0])]
        if place.epsg:
            entries.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, place.epsg]))
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at, table, more = 8 + len(body), b"", b""
    start = at + 2 + 12 * len(entries) + 4
    for tag, code, values in sorted(entries):
        packed = struct.pack("<" + _CODE[code] * len(values), *values)
        if len(packed) > 4:
            table += struct.pack("<HHII", tag, code, len(values), start + len(more))
            more += packed
        else:
            table += struct.pack("<HHI", tag, code, len(values)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(entries)) + table + b"\0" * 4 + more
