"""Binary workbooks, put together by hand record by record."""

import datetime
import struct

import pytest

from siltstone.sources import delimited as D
from siltstone.sources import xls


def record(kind, payload=b""):
    return struct.pack("<HH", kind, len(payload)) + payload


def text(s, long=True, wide=False):
    return struct.pack("<HB" if long else "<BB", len(s), int(wide)) + s.encode("utf-16-le" if wide else "latin-1")


def bof(kind):
    return record(xls.BOF, struct.pack("<HHHHII", xls.BIFF8, kind, 0, 0, 0, 0))


def sst(parts):
    """A table of strings as one record and its continuations."""
    return record(xls.SST, parts[0]) + b"".join(record(xls.CONTINUE, p) for p in parts[1:])


def workbook(sheet: bytes, strings: bytes = b"", extra: bytes = b""):
    styles = b"".join(record(xls.XF, struct.pack("<HH", 0, f) + b"\0" * 16) for f in (0, 14, 164, 165))
    formats = record(xls.FORMAT, struct.pack("<H", 164) + text("yyyy\\-mm")) + record(xls.FORMAT, struct.pack("<H", 165) + text('0.0"d"'))

    def head(start):
        return bof(5) + extra + formats + styles + record(xls.SHEET, struct.pack("<IBB", start, 0, 0) + text("Лист", False, True)) + record(xls.SHEET, struct.pack("<IBB", 0, 0, 2) + text("chart", False)) + strings + record(xls.EOF)

    start = len(head(0))
    return head(start) + bof(16) + sheet + record(xls.EOF)


def container(stream: bytes, name="Workbook", cutoff=4096, spoil=None) -> bytes:
    """A compound file with one stream: table, directory and, for short streams, the small ones."""
    small = len(stream) < cutoff
    body = stream.ljust(-(-len(stream) // 512) * 512, b"\0")
    n = len(body) // 512
    end, free, table = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
    tables = next(f for f in range(1, 100) if f * 128 >= n + f + 2)
    first = tables + 2  # of the stream, after the tables, the directory and the small table
    fat = [table] * tables + [end, end] + [first + i + 1 for i in range(n - 1)] + [end]
    if spoil:
        fat = spoil(fat)
    minis = [i + 1 for i in range(-(-len(stream) // 64) - 1)] + [end] if small else []

    def entry(title, kind, start, size):
        raw = title.encode("utf-16-le")
        return (raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, free, free, free) + b"\0" * 36 + struct.pack("<IQ", start, size)).ljust(128, b"\0")

    folder = entry("Root Entry", 5, first if small else end, len(body) if small else 0) + entry(name, 2, 0 if small else first, len(stream)) + entry("", 0, 0, 0) * 2
    head = (xls.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIII", 0, tables, tables, 0) + struct.pack("<I", cutoff)
            + struct.pack("<IIII", tables + 1 if small else end, 1 if small else 0, end, 0) + struct.pack("<109I", *range(tables), *[free] * (109 - tables)))
    sectors = [struct.pack(f"<{len(fat)}I", *fat).ljust(512 * tables, b"\xff"), folder, struct.pack(f"<{len(minis)}I", *minis).ljust(512, b"\xff")]
    return head.ljust(512, b"\0") + b"".join(sectors) + body


def cell(kind, row, col, xf, rest):
    return record(kind, struct.pack("<HHH", row, col, xf) + rest)


def rk(value, hundredths=False):
    return struct.pack("<i", (value << 2) | 2 | hundredths)


def sample():
    strings = sst([struct.pack("<II", 3, 3) + text("plain") + struct.pack("<HB", 6, 0) + b"abc", b"\x01" + "déж".encode("utf-16-le") + struct.pack("<HBHI", 2, 0x0D, 1, 4) + "ий".encode("utf-16-le") + b"\0" * 8])
    sheet = (
        cell(xls.LABEL_SST, 0, 0, 0, struct.pack("<I", 0)) + cell(xls.LABEL_SST, 0, 1, 0, struct.pack("<I", 1)) + cell(xls.LABEL_SST, 0, 2, 0, struct.pack("<I", 2))
        + cell(xls.NUMBER, 1, 0, 0, struct.pack("<d", 2.5)) + cell(xls.NUMBER, 1, 1, 1, struct.pack("<d", 61.0)) + cell(xls.RK, 1, 2, 2, rk(367)) + cell(xls.RK, 1, 3, 3, rk(-1250, True))
        + record(xls.MULTIPLE_RK, struct.pack("<HH", 2, 1) + struct.pack("<H", 0) + rk(7) + struct.pack("<H", 0) + struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) + struct.pack("<H", 2))
        + cell(xls.BOOL_OR_ERROR, 3, 0, 0, b"\x01\x00") + cell(xls.BOOL_OR_ERROR, 3, 1, 0, b"\x07\x01") + cell(xls.LABEL, 3, 2, 0, text("old"))
        + cell(xls.FORMULA, 4, 0, 0, struct.pack("<d", 9.0) + b"\0" * 8) + cell(xls.FORMULA, 4, 1, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(xls.STRING, text("сумма", wide=True))
        + cell(xls.FORMULA, 4, 2, 0, b"\x01\0\x01\0\0\0\xff\xff" + b"\0" * 8) + cell(xls.FORMULA, 4, 3, 0, b"\x02\0\x2a\0\0\0\xff\xff" + b"\0" * 8)
        + record(xls.MERGED, struct.pack("<H4H", 1, 0, 1, 5, 6)) + cell(xls.NUMBER, 0, 5, 0, struct.pack("<d", 4.0)))
    return workbook(sheet, strings)


WANT = {"Лист": [
    (1, {0: "plain", 1: "abcdéж", 2: "ий", 5: 4.0, 6: 4.0}),
    (2, {0: 2.5, 1: datetime.datetime(1900, 3, 1), 2: datetime.datetime(1901, 1, 1), 3: -12.5, 5: 4.0, 6: 4.0}),
    (3, {1: 7.0, 2: 1.5}), (4, {0: True, 1: "#DIV/0!", 2: "old"}), (5, {0: 9.0, 1: "сумма", 2: True, 3: "#N/A"})]}


def read(data):
    return xls.read_xls(data, D.shows_date, D.moment)


@pytest.mark.parametrize("cutoff", [4096, 1])
def test_a_workbook_is_read(cutoff):
    got = read(container(sample(), cutoff=cutoff))
    assert {s: [(n, dict(sorted(c.items()))) for n, c in rows] for s, rows in got.items()} == WANT


def test_workbooks_are_cells_of_a_table(spark):
    files = spark.createDataFrame([("a.xls", bytearray(container(sample()))), ("b.xls", bytearray(container(sample(), cutoff=1)))], "path string, content binary")
    got = D.sheet_cells(files, "xls")
    assert got.count() == 2 * sum(len(c) for _, c in WANT["Лист"])
    assert sorted(r["value"] for r in got.where("path = 'b.xls' and row_number = 5").collect()) == ["#N/A", "9.0", "True", "сумма"]


def test_long_tables_of_strings_and_the_later_epoch():
    many = ["s%d" % i + "x" * (i % 50) for i in range(3000)]
    raw, parts = struct.pack("<II", 3000, 3000), []
    for s in many:
        if len(raw) + len(s) + 3 > 8000:
            parts.append(raw)
            raw = b""
        raw += text(s)
    sheet = b"".join(cell(xls.LABEL_SST, i, 0, 0, struct.pack("<I", i)) for i in range(3000)) + cell(xls.RK, 0, 1, 1, rk(1))
    got = read(container(workbook(sheet, sst([*parts, raw]), record(xls.DATE_MODE, struct.pack("<H", 1)))))["Лист"]
    assert [c[0] for _, c in got] == many and got[0][1][1] == datetime.datetime(1904, 1, 2)


def test_damaged_files_end_in_an_error():
    good = container(sample(), cutoff=1)
    loop = container(sample(), cutoff=1, spoil=lambda fat: fat[:3] + [3] * (len(fat) - 3))
    astray = container(sample(), cutoff=1, spoil=lambda fat: fat[:3] + [9000] * (len(fat) - 3))
    locked = container(workbook(b"", extra=record(xls.FILE_PASS, b"\0" * 6)))
    old = container(sample(), name="Book")
    for data in (b"", b"PK\x03\x04" + b"\0" * 900, good[:700], good[:1600], loop, astray, locked, old, container(sample(), name="Other"), container(workbook(cell(xls.LABEL_SST, 0, 0, 0, struct.pack("<I", 5))))):
        with pytest.raises(ValueError):
            read(data)
    for cut in range(0, len(good), 37):
        for at in range(3):
            spoiled = bytearray(good)
            spoiled[cut: cut + 4] = struct.pack("<I", (0xFFFFFFFF, 0, 0x7FFFFFFF)[at])
            try:
                read(bytes(spoiled))
            except ValueError:
                pass
