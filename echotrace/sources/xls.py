"""The old binary workbook format (BIFF8 in a compound file): sheets and their cells, one sheet at a time."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Sector numbers from here on stand for ends and free sectors.
_LAST_SECTOR = 0xFFFFFFF9
#: Record types, fixed by the format.
_BOF, _EOF, _CONTINUE, _FILEPASS, _BOUNDSHEET, _SST, _FORMAT, _XF = 0x809, 0x0A, 0x3C, 0x2F, 0x85, 0xFC, 0x41E, 0xE0
_LABELSST, _LABEL, _NUMBER, _RK, _MULRK, _FORMULA, _STRING = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


class Sheet(NamedTuple):
    name: str
    hidden: bool
    start: int  #: of its records in the workbook's stream


def shows_date(code: str) -> bool:
    """Whether a format code, without its literal parts, has signs of dates or times."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.IGNORECASE))


def stream_of(body: bytes, *names: str) -> bytes:
    """The first of these streams that the compound file has; ValueError if it is cut, goes round in a circle or has none."""
    if body[:8] != SIGNATURE or len(body) < 512:
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", body, 30)
    tables, first_folder, cutoff, first_small, _, first_list, _ = struct.unpack_from("<II4xIIIII", body, 44)
    if shift not in (9, 12):
        raise ValueError(f"sectors of 2^{shift} bytes")
    size = 1 << shift

    def sector(n: int) -> bytes:
        part = body[(n + 1) << shift : (n + 2) << shift]
        if len(part) < size and (n + 1) << shift >= len(body):
            raise ValueError(f"sector {n} is missing")
        return part.ljust(size, b"\0")

    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b))
    listed, at, seen = list(struct.unpack_from("<109I", body, 76)), first_list, set()
    while at < _LAST_SECTOR:
        if at in seen:
            raise ValueError("the list of tables goes round in a circle")
        seen.add(at)
        *more, at = numbers(sector(at))
        listed += more
    following = [x for t in listed[: max(tables, 0)] if t < _LAST_SECTOR for x in numbers(sector(t))]

    def chain(n: int, table: list[int]) -> Iterator[int]:
        left = len(table)
        while n < _LAST_SECTOR:
            if n >= len(table) or left < 0:
                raise ValueError("a chain of sectors leaves the file or goes round in a circle")
            yield n
            n, left = table[n], left - 1

    whole = lambda n: b"".join(map(sector, chain(n, following)))
    folder, root, found = whole(first_folder), None, {}
    for i in range(0, len(folder) - 127, 128):
        length, kind = struct.unpack_from("<HB", folder, i + 64)
        start, n = struct.unpack_from("<II", folder, i + 116)
        if kind == 5:
            root = start
        elif kind == 2:
            found[folder[i : i + max(0, length - 2)].decode("utf-16-le", "replace").lower()] = start, n
    for name in names:
        if name.lower() in found:
            start, n = found[name.lower()]
            if n >= cutoff:
                out = whole(start)
            else:
                small = whole(root) if root is not None else b""
                table = numbers(whole(first_small)) if first_small < _LAST_SECTOR else []
                out = b"".join(small[k << small_shift : (k + 1) << small_shift] for k in chain(start, table))
            if len(out) < n:
                raise ValueError(f"{name} is cut: {len(out)} of {n} bytes")
            return out[:n]
    raise ValueError("no workbook in the compound file")


def _records(stream: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Type and parts (the record's own, then those that continue it) up to the end of a sheet or of the stream."""
    kind, parts = None, []
    while True:
        if at + 4 > len(stream):
            raise ValueError("records end in the middle")
        k, n = struct.unpack_from("<HH", stream, at)
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if len(body) < n:
            raise ValueError("a record is cut")
        if k == _CONTINUE and parts:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        if k == _EOF:
            return
        kind, parts = k, [body]


class _Text:
    """Strings from a record's parts; where one goes on in the next part, its width is told anew there."""

    def __init__(self, parts: list[bytes], at: int = 0) -> None:
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out):
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("a string is cut")
            some = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + some, self.at + len(some)
        return out

    def string(self, counted: int = 2) -> str:
        left, flags = int.from_bytes(self.take(counted), "little"), self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        wide, out = flags & 1, ""
        while left:
            if self.at >= len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("a string is cut")
                wide, self.at = self.parts[self.part][0] & 1, 1
            n = min(left, (len(self.parts[self.part]) - self.at) // (2 if wide else 1))
            if not n:
                raise ValueError("a string is cut")
            some = self.take(n * (2 if wide else 1))
            out += some.decode("utf-16-le", "surrogatepass") if wide else some.decode("latin-1")
            left -= n
        self.take(4 * runs + extra)
        return out


def _rk(x: int) -> float:
    """A number of 30 bits: an integer or the head of a double, perhaps of hundredths."""
    value = float((x if x < 1 << 31 else x - (1 << 32)) >> 2) if x & 2 else struct.unpack("<d", struct.pack("<II", 0, x & ~3))[0]
    return value / 100 if x & 1 else value


class Workbook:
    """sheets, and the cells of each."""

    def __init__(self, body: bytes) -> None:
        self.stream = stream_of(body, "Workbook", "Book")
        self.sheets: list[Sheet] = []
        self._strings: list[str] = []
        formats: dict[int, str] = {}
        styles: list[int] = []
        for kind, parts in _records(self.stream, 0):
            if kind == _BOF and struct.unpack_from("<H", parts[0])[0] != 0x600:
                raise ValueError("a workbook older than BIFF8")
            if kind == _FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == _BOUNDSHEET:
                start, state, what = struct.unpack_from("<IBB", parts[0])
                if what == 0:  # a sheet of cells
                    self.sheets.append(Sheet(_Text(parts, 6).string(1), state != 0, start))
            elif kind == _FORMAT:
                formats[struct.unpack_from("<H", parts[0])[0]] = _Text(parts, 2).string()
            elif kind == _XF:
                styles.append(struct.unpack_from("<H", parts[0], 2)[0])
            elif kind == _SST:
                reader = _Text(parts, 8)
                self._strings = [reader.string() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
        self._dated = [shows_date(formats[f]) if f in formats else f in DATE_FORMATS for f in styles]

    def cells(self, sheet: Sheet) -> list[tuple[int, int, float | str]]:
        """Row and column, from 1, and the number or text, in this order; dates, truth values and errors are left out."""
        out: list[tuple[int, int, float | str]] = []

        def add(row: int, column: int, style: int, value: float | str) -> None:
            if isinstance(value, str) or not (style < len(self._dated) and self._dated[style]):
                out.append((row + 1, column + 1, value))

        asked: tuple[int, int, int] | None = None  # a formula whose text comes in a record of its own
        for kind, parts in _records(self.stream, sheet.start):
            b = parts[0]
            if kind == _NUMBER:
                add(*struct.unpack_from("<HHHd", b))
            elif kind == _RK:
                row, column, style, x = struct.unpack_from("<HHHI", b)
                add(row, column, style, _rk(x))
            elif kind == _MULRK:
                row, column = struct.unpack_from("<HH", b)
                for i in range((len(b) - 6) // 6):
                    style, x = struct.unpack_from("<HI", b, 4 + 6 * i)
                    add(row, column + i, style, _rk(x))
            elif kind == _LABELSST:
                row, column, style, i = struct.unpack_from("<HHHI", b)
                if i >= len(self._strings):
                    raise ValueError(f"string {i} is missing")
                add(row, column, style, self._strings[i])
            elif kind == _LABEL:
                add(*struct.unpack_from("<HHH", b), _Text(parts, 6).string())
            elif kind == _FORMULA:
                row, column, style = at = struct.unpack_from("<HHH", b)
                if b[12:14] != b"\xff\xff":
                    add(row, column, style, struct.unpack_from("<d", b, 6)[0])
                elif b[6] == 0:
                    asked = at
            elif kind == _STRING and asked:
                add(*asked, _Text(parts).string())
                asked = None
        return sorted(out, key=lambda c: c[:2])
