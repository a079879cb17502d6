"""Delimited text, JSON records and spreadsheets as rows of cells."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import xls

DELIMITERS = ",;\t|"
#: First bytes of container files (fixed values).
SIGNATURES = {b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "ole2", b"%PDF": "pdf", b"\x1f\x8b": "gzip"}
#: Built-in spreadsheet number formats that show dates (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def container(head: bytes) -> str | None:
    """What a file's first bytes say it is, whatever its extension."""
    return next((kind for mark, kind in SIGNATURES.items() if head.startswith(mark)), None)


def decode(data: bytes) -> str:
    """By byte order mark, else UTF-8, else Windows-1251."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("windows-1251", "replace")


def plain_text(data: bytes) -> str | None:
    """UTF-8, UTF-16 or Latin-1 text; None for binary data (many zero bytes at the start)."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if data[:2000].count(0) > 5:
        return None
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse(text: str, delimiter: str = ",") -> list[list[str]]:
    """Records with quoted fields, doubled quotes and line breaks inside quotes; blank lines skipped."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1: i + 2] == '"':
                cell += '"'
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c == delimiter:
            row.append(cell)
            cell = ""
        elif c in "\r\n":
            if c == "\r" and text[i + 1: i + 2] == "\n":
                i += 1
            if row or cell.strip():
                rows.append([*row, cell])
            row, cell = [], ""
        else:
            cell += c
        i += 1
    if row or cell.strip():
        rows.append([*row, cell])
    return rows


def sniff(text: str) -> str:
    """The delimiter whose count is the same on most of the first lines, then the one that gives more fields."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best, found = (0.0, 0), ","
    for d in DELIMITERS:
        counts = [len(r) - 1 for x in lines for r in parse(x, d)]
        usual = max(set(counts), key=counts.count) if counts else 0
        if usual:
            score = (counts.count(usual) / len(counts), usual)
            if score > best:
                best, found = score, d
    return found


def table(text: str, delimiter: str | None = None) -> tuple[list[str], list[list[str]]]:
    """Header names, blank ones numbered, and rows padded to them."""
    rows = parse(text, delimiter or sniff(text))
    if not rows:
        return [], []
    names = [c.strip() or f"column{i + 1}" for i, c in enumerate(rows[0])]
    return names, [(r + [""] * len(names))[: len(names)] for r in rows[1:]]


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Large delimited files: all columns text, quotes doubled inside quotes, line breaks allowed there."""
    return spark.read.csv(path, sep=delimiter, header=header, quote='"', escape='"', multiLine=True, inferSchema=False)


def typed_cells(lines: DataFrame, delimiter: str = ",", line: str = "value", number: str = "row_number") -> DataFrame:
    """(row_number, col, text, kind) of the cells of unquoted lines."""
    cells = F.posexplode(F.split(F.col(line), re.escape(delimiter), -1)).alias("col", "text")
    return lines.select(F.col(number), cells).withColumn("kind", V.delimited_kind(F.col("text")))


def json_records(text: str) -> tuple[list[str], list[dict]]:
    """Records of a JSON array, or of an object's documents, items or rows; columns in order of first sight, values as text."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = next((data[k] for k in ("documents", "items", "rows") if isinstance(data.get(k), list)), [])
    rows = [{k: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False) for k, v in r.items()} for r in data if isinstance(r, dict)]
    return list(dict.fromkeys(k for r in rows for k in sorted(r))), rows


def suggested_mapping(columns: list[str]) -> dict[str, str]:
    """The id and text columns by their usual names; all others are metadata."""
    out = {}
    for role, names in (("id", ("id", "_id", "doc_id", "key")), ("text", ("text", "document", "content", "body", "description"))):
        found = next((c for n in names for c in columns if c.lower() == n), None)
        if found:
            out[found] = role
    return {c: out.get(c, "metadata") for c in columns}


def prepared(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, document, metadata columns): texts trimmed, empty ones dropped."""
    by = {role: c for c, role in mapping.items()}
    meta = [F.trim(F.col(c).cast("string")).alias(c) for c, r in mapping.items() if r == "metadata"]
    key = F.trim(F.col(by["id"]).cast("string")) if "id" in by else F.sha2(F.trim(F.col(by["text"])), 256)
    return df.select(key.alias("id"), F.trim(F.col(by["text"])).alias("document"), *meta).where("document != ''")


def _column(ref: str) -> int:
    return V.column_index(re.match(r"[A-Z]+", ref)[0])


def shows_date(number: int, code: str) -> bool:
    """Whether a number format, built in or with a code of its own, shows a date or time."""
    return number in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code), re.I))


def moment(serial: float, late: bool):
    """The date of a spreadsheet's number, counted from 1904 if ``late``; the day that never was stays a number."""
    import datetime

    if late:
        return datetime.datetime(1904, 1, 1) + datetime.timedelta(days=serial)
    if 60 <= serial < 61:
        return serial
    return datetime.datetime(1899, 12, 30) + datetime.timedelta(days=serial + (serial < 60))


def read_xlsx(data: bytes, epoch_1904: bool | None = None) -> dict[str, list[tuple[int, dict[int, object]]]]:
    """Rows (number, cells by column) of every sheet; shared strings, booleans, dates by number format, merged ranges filled."""
    n = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    z = zipfile.ZipFile(io.BytesIO(data))
    part = lambda p: ET.fromstring(z.read(p)) if p in z.namelist() else None
    shared = ["".join(t.text or "" for t in si.iter(f"{{{n['m']}}}t")) for si in (part("xl/sharedStrings.xml") if part("xl/sharedStrings.xml") is not None else [])]
    dated, styles = [], part("xl/styles.xml")
    if styles is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iterfind(".//m:numFmt", n)}
        for xf in styles.iterfind("m:cellXfs/m:xf", n):
            i = int(xf.get("numFmtId", 0))
            dated.append(shows_date(i, own.get(i, "")))
    book, rels = part("xl/workbook.xml"), part("xl/_rels/workbook.xml.rels")
    props = book.find("m:workbookPr", n)
    late = epoch_1904 if epoch_1904 is not None else props is not None and props.get("date1904") in ("1", "true")
    target = {r.get("Id"): r.get("Target") for r in rels}

    out = {}
    for s in book.iterfind("m:sheets/m:sheet", n):
        path = target[s.get(f"{{{n['r']}}}id")]
        sheet = part(path.lstrip("/") if path.startswith("/") else f"xl/{path}")
        rows: dict[int, dict[int, object]] = {}
        for row in sheet.iterfind("m:sheetData/m:row", n):
            number = int(row.get("r", len(rows) + 1))
            cells = rows.setdefault(number, {})
            for c in row.iterfind("m:c", n):
                kind, v = c.get("t"), c.find("m:v", n)
                at = _column(c.get("r")) if c.get("r") else len(cells)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{n['m']}}}t"))
                elif v is not None and v.text is not None:
                    if kind == "s":
                        cells[at] = shared[int(v.text)]
                    elif kind == "b":
                        cells[at] = v.text == "1"
                    elif kind in ("str", "e"):
                        cells[at] = v.text
                    else:
                        x, style = float(v.text), int(c.get("s", 0))
                        cells[at] = moment(x, late) if style < len(dated) and dated[style] else x
        for m in sheet.iterfind("m:mergeCells/m:mergeCell", n):
            a, b = (m.get("ref").split(":") * 2)[:2]
            r0, r1 = int(re.search(r"\d+", a)[0]), int(re.search(r"\d+", b)[0])
            value = rows.get(r0, {}).get(_column(a))
            if value is not None:
                for r in range(r0, r1 + 1):
                    for col in range(_column(a), _column(b) + 1):
                        rows.setdefault(r, {})[col] = value
        out[s.get("name")] = sorted(rows.items())
    return out


def read_ods(data: bytes) -> dict[str, list[tuple[int, dict[int, object]]]]:
    """Rows of every sheet of an OpenDocument spreadsheet, repeated rows and cells written out."""
    import datetime

    t, o, x = ("{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}")
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    out = {}
    for sheet in root.iter(f"{t}table"):
        rows, number = [], 0
        for row in sheet.iter(f"{t}table-row"):
            times, cells, col = int(row.get(f"{t}number-rows-repeated", 1)), {}, 0
            for c in row:
                if c.tag not in (f"{t}table-cell", f"{t}covered-table-cell"):
                    continue
                again, kind = int(c.get(f"{t}number-columns-repeated", 1)), c.get(f"{o}value-type")
                value = None
                if kind in ("float", "currency", "percentage"):
                    value = float(c.get(f"{o}value"))
                elif kind == "boolean":
                    value = c.get(f"{o}boolean-value") == "true"
                elif kind == "date":
                    value = datetime.datetime.fromisoformat(c.get(f"{o}date-value"))
                elif kind == "string":
                    value = "\n".join("".join(p.itertext()) for p in c.iter(f"{x}p"))
                if value is not None:
                    for i in range(again):
                        cells[col + i] = value
                col += again
            if cells:
                for i in range(times):
                    rows.append((number + 1 + i, dict(cells)))
            number += times
        out[sheet.get(f"{t}name")] = rows
    return out


def sheet_cells(files: DataFrame, kind: str = "xlsx", most_rows: int | None = None) -> DataFrame:
    """(path, sheet, row_number, col, kind, value) of the cells of spreadsheet files (path, content), read file by file where they are.

    With ``most_rows`` only so many rows of a sheet are taken, and where there
    are more a row of kind ``rows_left`` without a number says how many.
    """

    def run(batches):
        import pyarrow as pa

        read = {"xlsx": read_xlsx, "ods": read_ods, "xls": lambda content: xls.read_xls(content, shows_date, moment)}[kind]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for sheet, own in read(content).items():
                    rows += [(path, sheet, n, c, type(v).__name__, str(v)) for n, cells in own[:most_rows] for c, v in sorted(cells.items())]
                    if most_rows is not None and len(own) > most_rows:
                        rows.append((path, sheet, None, None, "rows_left", str(len(own) - most_rows)))
                cols = list(zip(*rows)) or [[]] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types)], ["path", "sheet", "row_number", "col", "kind", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row_number long, col int, kind string, value string")


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, ext) below a folder; lock files and temporary ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("ext", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).where(~name.rlike(r"^(~\$|\.)|\.(tmp|lock|part)$"))
    return files if not extensions else files.where(F.col("ext").isin([e.lower() for e in extensions]))


def settled(files: DataFrame, now, large: int = 1 << 20, seconds: int = 5) -> DataFrame:
    """Files that nobody is writing: large ones must have rested a few seconds."""
    resting = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("mtime") >= seconds
    return files.where((F.col("size") < large) | resting)
