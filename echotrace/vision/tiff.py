"""TIFF files, page by page: strips and tiles, 1 to 16 bits, gray, colour tables and colour; uncompressed, PackBits, LZW and deflate."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Tags and field sizes, fixed by the format.
_WIDTH, _HEIGHT, _BITS, _PACKING, _MEANING, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANES, _PREDICTOR, _TABLE, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _KIND = 284, 317, 320, 322, 323, 324, 325, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Bytes of a decoded page at most.
MOST_BYTES = 1 << 31


def packbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, last = list(first), 9, bytearray(), b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif last and code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("a code is not in the table")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _unpacked(data: bytes, packing: int, size: int) -> bytes:
    if packing == 1:
        out = data
    elif packing == 5:
        out = lzw(data, size)
    elif packing in (8, 32946):
        out = zlib.decompressobj().decompress(data, size)
    elif packing == 32773:
        out = packbits(data, size)
    else:
        raise ValueError(f"compression {packing}")
    if len(out) < size:
        raise ValueError("a strip or tile is cut")
    return out[:size]


def _fields(body: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    """The whole numbers of a directory by tag, and the next directory's place."""
    (n,) = struct.unpack_from(f"{order}H", body, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", body, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * i
        if _SIZES[kind] * count > 4:
            (place,) = struct.unpack_from(f"{order}I", body, place)
        if place + _SIZES[kind] * count > len(body):
            raise ValueError("a field lies beyond the file's end")
        out[tag] = struct.unpack_from(f"{order}{count}{'_B_HI'[kind]}", body, place)
    return out, struct.unpack_from(f"{order}I", body, at + 2 + 12 * n)[0]


def _samples(raw: bytes, height: int, width: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """height x width x samples of a strip or tile, rows padded to whole bytes."""
    if bits == 16:
        a = np.frombuffer(raw, f"{order}u2").astype(np.uint16).reshape(height, width, samples)
    elif bits == 8:
        a = np.frombuffer(raw, np.uint8).reshape(height, width, samples)
    else:
        rows = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, -1), axis=1)[:, : width * samples * bits]
        a = (rows.reshape(height, width, samples, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)
    return np.cumsum(a, axis=1, dtype=a.dtype) if predictor == 2 else a


def _page(body: bytes, order: str, f: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda tag, other=None: f[tag][0] if tag in f else other
    width, height, samples, bits = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1), one(_BITS, 1)
    if not width or not height or width * height * samples * 2 > MOST_BYTES:
        raise ValueError(f"a page of {width} x {height}")
    if bits not in (1, 2, 4, 8, 16) or set(f.get(_BITS, (1,))) != {bits} or one(_KIND, 1) != 1:
        raise ValueError(f"samples of {f.get(_BITS)} bits")
    apart = one(_PLANES, 1) == 2
    deep = 1 if apart else samples
    tiled = _TILES in f
    w, h = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (width, min(one(_STRIP_ROWS, height), height))
    places, sizes = (f[_TILES], f[_TILE_BYTES]) if tiled else (f[_STRIPS], f[_STRIP_BYTES])
    across, down = -(-width // w), -(-height // h)
    if len(places) < across * down * (samples if apart else 1) or len(sizes) < len(places):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    for i in range(across * down * (samples if apart else 1)):
        plane, k = divmod(i, across * down)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = _unpacked(body[places[i] : places[i] + sizes[i]], one(_PACKING, 1), rows * -(-w * deep * bits // 8))
        part = _samples(raw, rows, w, deep, bits, order, one(_PREDICTOR, 1))[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
    meaning = one(_MEANING, 1)
    if meaning == 3:
        table = (np.array(f[_TABLE], np.uint32).reshape(3, -1) >> 8).astype(np.uint8)
        return np.ascontiguousarray(table[::-1, out[:, :, 0]].transpose(1, 2, 0))
    if meaning not in (0, 1, 2):
        raise ValueError(f"colours of kind {meaning}")
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    if meaning == 0:
        out = np.iinfo(out.dtype).max - out
    return np.ascontiguousarray(np.concatenate([out[:, :, 2::-1], out[:, :, 3:4]], axis=2) if samples >= 3 else out[:, :, :1])


def pages(body: bytes) -> Iterator[np.ndarray]:
    """Every page in order: height x width x channels (gray, BGR or BGRA), of 8 or 16 bits. ValueError where a page can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    if order is None or len(body) < 8 or struct.unpack_from(f"{order}H", body, 2)[0] != 42:
        raise ValueError("no TIFF file")
    (at,) = struct.unpack_from(f"{order}I", body, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the pages go round in a circle")
        seen.add(at)
        try:
            fields, at = _fields(body, order, at)
        except struct.error as e:
            raise ValueError("a directory is cut") from e
        try:
            yield _page(body, order, fields)
        except (KeyError, zlib.error) as e:
            raise ValueError(f"a page can't be read: {e!r}") from e
