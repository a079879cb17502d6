"""Binary workbooks (.xls): streams of a compound file, and the records of a BIFF8 workbook in one of them.

Both formats are Microsoft's published ones (MS-CFB, MS-XLS). A file that
contradicts itself raises ``ValueError``; chains of sectors are followed no
further than there are sectors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the container format.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR = 0xFFFFFFFA  # larger numbers are marks: end of chain, free, tables
HEADER_ENTRIES = 109  # table sectors that the header lists itself
ENTRY = 128  # bytes of a directory entry
STREAM, ROOT = 2, 5

# Fixed values of the workbook format: record types.
FORMULA, EOF, DATE_MODE, FILE_PASS, CONTINUE = 0x0006, 0x000A, 0x0022, 0x002F, 0x003C
SHEET, MULTIPLE_RK, RICH_STRING, XF, MERGED, SST, LABEL_SST = 0x0085, 0x00BD, 0x00D6, 0x00E0, 0x00E5, 0x00FC, 0x00FD
NUMBER, LABEL, BOOL_OR_ERROR, STRING, RK, FORMAT, BOF = 0x0203, 0x0204, 0x0205, 0x0207, 0x027E, 0x041E, 0x0809
BIFF8 = 0x0600
#: Texts of error cells (fixed values).
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Container:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(MAGIC):
            raise ValueError("no compound file")
        shift, small = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small != 6:
            raise ValueError("sectors of an unknown size")
        self.data, self.sector = data, 1 << shift
        first_dir, self.cutoff = struct.unpack_from("<I4xI", data, 48)
        first_small, _, more, _ = struct.unpack_from("<IIII", data, 60)
        listed = list(struct.unpack_from(f"<{HEADER_ENTRIES}I", data, 76))
        per = self.sector // 4
        for _ in range(len(data) // self.sector + 1):
            if more >= LAST_SECTOR:
                break
            table = np.frombuffer(self._sector(more), "<u4")
            listed += table[: per - 1].tolist()
            more = int(table[-1])
        else:
            raise ValueError("the list of table sectors goes round")
        self.next = np.concatenate([np.frombuffer(self._sector(s), "<u4") for s in listed if s < LAST_SECTOR] or [np.zeros(0, "<u4")])
        self.small_next = np.frombuffer(self._follow(first_small), "<u4") if first_small < LAST_SECTOR else np.zeros(0, "<u4")
        folder, self.entries = self._follow(first_dir), {}
        small_start = None
        for at in range(0, len(folder) - ENTRY + 1, ENTRY):
            size, kind = struct.unpack_from("<HB", folder, at + 64)
            start, length = struct.unpack_from("<IQ", folder, at + 116)
            if kind == ROOT:
                small_start = start
            elif kind == STREAM:
                name = folder[at: at + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
                self.entries[name.lower()] = (start, length if self.sector > 512 else length & 0xFFFFFFFF)
        if small_start is None:
            raise ValueError("no root entry")
        self.small = self._follow(small_start) if small_start < LAST_SECTOR else b""

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.sector
        if at >= len(self.data):
            raise ValueError(f"sector {number} lies beyond the file")
        return self.data[at: at + self.sector].ljust(self.sector, b"\0")

    def _chain(self, start: int, table: np.ndarray) -> Iterator[int]:
        now = start
        for _ in range(len(table)):
            if now >= LAST_SECTOR:
                return
            if now >= len(table):
                raise ValueError(f"sector {now} is in no table")
            yield now
            now = int(table[now])
        if now < LAST_SECTOR:
            raise ValueError("a chain of sectors goes round")

    def _follow(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._chain(start, self.next)))

    def stream(self, name: str) -> bytes | None:
        if name.lower() not in self.entries:
            return None
        start, length = self.entries[name.lower()]
        if not length:
            return b""
        if length >= self.cutoff:
            out = self._follow(start)
        else:
            out = b"".join(self.small[64 * s: 64 * s + 64] for s in self._chain(start, self.small_next))
        if len(out) < length:
            raise ValueError(f"{name} is cut short")
        return out[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, payloads) up to the end of the substream; continued records come as one with several payloads."""
    kind, parts, depth = None, [], 0
    while at + 4 <= len(stream):
        now, size = struct.unpack_from("<HH", stream, at)
        payload = stream[at + 4: at + 4 + size]
        if len(payload) < size:
            raise ValueError("a record is cut short")
        at += 4 + size
        if now == CONTINUE and kind is not None:
            parts.append(payload)
            continue
        if kind is not None and depth == 1:
            yield kind, parts
        depth += (now == BOF) - (now == EOF)
        kind, parts = now, [payload]
        if now == EOF and depth <= 0:
            return
    if kind is not None:
        yield kind, parts


class Pieces:
    """Bytes of a record over its payloads. Characters that run into the next one are told there anew how wide they are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.at, self.of = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            self._turn()
            part = self.parts[self.of][self.at: self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out

    def _turn(self) -> bool:
        """Go to the next payload at the end of this one; whether it was."""
        turned = False
        while self.at >= len(self.parts[self.of]):
            self.of, self.at, turned = self.of + 1, 0, True
            if self.of >= len(self.parts):
                raise ValueError("a string is cut short")
        return turned

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def text(self, long: bool = True) -> str:
        left, flags = self.number(2 if long else 1), self.number(1)
        runs, phonetic = self.number(2) if flags & 8 else 0, self.number(4) if flags & 4 else 0
        wide, out = flags & 1, []
        while left:
            if self._turn():
                wide = self.number(1) & 1
            room = len(self.parts[self.of]) - self.at
            n = min(left, room // (1 + wide))
            if not n:
                raise ValueError("a character is cut in two")
            out.append(self.take(n * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace"))
            left -= n
        self.take(4 * runs + phonetic)
        return "".join(out)


def packed_number(value: int) -> float:
    """A number of 30 bits: an integer or the upper half of a double, perhaps in hundredths."""
    if value & 2:
        out = float((value >> 2) - (1 << 30 if value & 0x80000000 else 0))
    else:
        out = struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return out / 100 if value & 1 else out


def _cells(stream: bytes, at: int, shared: list[str], typed) -> tuple[dict[int, dict[int, object]], list[tuple[int, int, int, int]]]:
    """(cells by row from 1 on and column, merged ranges) of the sheet at a place of the stream."""
    rows: dict[int, dict[int, object]] = {}
    merged, waits = [], None

    def put(row, col, value):
        rows.setdefault(row + 1, {})[col] = value

    for kind, parts in records(stream, at):
        p = parts[0]
        if kind == LABEL_SST:
            row, col, _, i = struct.unpack_from("<HHHI", p)
            if i >= len(shared):
                raise ValueError(f"shared string {i} does not exist")
            put(row, col, shared[i])
        elif kind == NUMBER:
            row, col, xf, x = struct.unpack_from("<HHHd", p)
            put(row, col, typed(x, xf))
        elif kind == RK:
            row, col, xf, x = struct.unpack_from("<HHHI", p)
            put(row, col, typed(packed_number(x), xf))
        elif kind == MULTIPLE_RK:
            row, col = struct.unpack_from("<HH", p)
            for i in range((len(p) - 6) // 6):
                xf, x = struct.unpack_from("<HI", p, 4 + 6 * i)
                put(row, col + i, typed(packed_number(x), xf))
        elif kind == BOOL_OR_ERROR:
            row, col, _, value, error = struct.unpack_from("<HHHBB", p)
            put(row, col, ERRORS.get(value, f"#{value}") if error else bool(value))
        elif kind in (LABEL, RICH_STRING):
            row, col = struct.unpack_from("<HH", p)
            pieces = Pieces(parts)
            pieces.take(6)
            put(row, col, pieces.text())
        elif kind == FORMULA:
            row, col, xf = struct.unpack_from("<HHH", p)
            if p[12:14] != b"\xff\xff":
                put(row, col, typed(struct.unpack_from("<d", p, 6)[0], xf))
            elif p[6] == 0:
                waits = row, col  # its text is the record after it
            elif p[6] in (1, 2):
                put(row, col, bool(p[8]) if p[6] == 1 else ERRORS.get(p[8], f"#{p[8]}"))
        elif kind == STRING and waits:
            put(*waits, Pieces(parts).text())
            waits = None
        elif kind == MERGED:
            merged += [struct.unpack_from("<HHHH", p, 2 + 8 * i) for i in range(struct.unpack_from("<H", p)[0])]
    return rows, merged


def read_xls(data: bytes, shows_date, moment, epoch_1904: bool | None = None) -> dict[str, list[tuple[int, dict[int, object]]]]:
    """Rows (number, cells by column) of every worksheet; texts, numbers, booleans, dates by number format, merged ranges filled.

    ``shows_date(number, code)`` tells date formats, ``moment(serial, late)``
    gives the date of a number.
    """
    try:
        box = Container(data)
        stream = box.stream("Workbook")
        if stream is None:
            raise ValueError("a workbook of an older kind" if box.stream("Book") is not None else "no workbook in the file")
        formats, styles, shared, sheets, late = {}, [], [], [], False
        for kind, parts in records(stream):
            p = parts[0]
            if kind == BOF and struct.unpack_from("<H", p)[0] != BIFF8:
                raise ValueError("a workbook of an older kind")
            if kind == FILE_PASS:
                raise ValueError("the workbook is protected by a password")
            if kind == DATE_MODE:
                late = bool(struct.unpack_from("<H", p)[0])
            elif kind == FORMAT:
                pieces = Pieces(parts)
                number = pieces.number(2)
                formats[number] = pieces.text()
            elif kind == XF:
                styles.append(struct.unpack_from("<H", p, 2)[0])
            elif kind == SHEET:
                start, _, sort = struct.unpack_from("<IBB", p)
                pieces = Pieces(parts)
                pieces.take(6)
                if sort == 0:  # charts and macros are no tables
                    sheets.append((pieces.text(long=False), start))
            elif kind == SST:
                pieces = Pieces(parts)
                pieces.take(4)
                shared = [pieces.text() for _ in range(pieces.number(4))]
        late = late if epoch_1904 is None else epoch_1904
        dated = [shows_date(i, formats.get(i, "")) for i in styles]
        out = {}
        for name, start in sheets:
            rows, merged = _cells(stream, start, shared, lambda x, xf: moment(x, late) if xf < len(dated) and dated[xf] else x)
            for top, bottom, left, right in merged:
                value = rows.get(top + 1, {}).get(left)
                if value is not None:
                    for r in range(top, bottom + 1):
                        for c in range(left, right + 1):
                            rows.setdefault(r + 1, {})[c] = value
            out[name] = sorted(rows.items())
        return out
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"the workbook is damaged: {e}") from e
