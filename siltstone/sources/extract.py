"""Texts of files: a registry of extractors, each for some kinds of file, run where the files are read.

Office and e-book formats are zipped XML and need nothing but the standard
library. Formats that need a rendering engine (PDF, scans, old binary office
files) have no extractor here; one can be registered.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import web
from . import delimited


class NoText(Exception):
    """The file is of the extractor's kind but holds no text; another extractor may find some."""


#: (name, extensions, function of the file's bytes)
Extractor = tuple[str, tuple[str, ...], Callable[[bytes], str]]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def plain(data: bytes) -> str:
    text = delimited.plain_text(data)
    if text is None or not text.strip():
        raise NoText
    return text


def html(data: bytes) -> str:
    text = web.read_page(web.decoded(data))["text"]
    if not text:
        raise NoText
    return text


def _word_paragraph(p) -> str:
    out = []
    for x in p.iter():
        kind = _local(x.tag)
        if kind == "t":
            out.append(x.text or "")
        elif kind == "tab":
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def docx(data: bytes) -> str:
    """Paragraphs of a Word document, headings marked by their level, tables as Markdown."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))[0]
    out = []
    for block in body:
        if _local(block.tag) == "p":
            text = _word_paragraph(block).strip()
            style = next((v for x in block.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            level = re.fullmatch(r"(?i)heading ?(\d)", style)
            out.append(f"{'#' * int(level[1])} {text}" if level and text else text)
        elif _local(block.tag) == "tbl":
            rows = [[" ".join(_word_paragraph(c).split()) for c in r if _local(c.tag) == "tc"] for r in block if _local(r.tag) == "tr"]
            out.append(web.markdown_table(rows))
    return _joined(out)


def odt(data: bytes) -> str:
    """Paragraphs and headings of an OpenDocument text."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    out = []
    for x in root.iter():
        if _local(x.tag) in ("h", "p"):
            text = " ".join("".join(x.itertext()).split())
            level = next((int(v) for k, v in x.attrib.items() if _local(k) == "outline-level"), 1)
            out.append("#" * level + " " + text if _local(x.tag) == "h" and text else text)
    return _joined(out)


def slides(data: bytes) -> list[str]:
    """The text of each slide of a presentation, in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for n in names:
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ET.fromstring(z.read(n)).iter() if _local(p.tag) == "p"]
        out.append("\n".join(x.strip() for x in lines if x.strip()))
    return out


def pptx(data: bytes) -> str:
    return _joined(slides(data))


def epub(data: bytes) -> str:
    """The chapters of an e-book in reading order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    container = ET.fromstring(z.read("META-INF/container.xml"))
    package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
    root = ET.fromstring(z.read(package))
    items = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
    order = [items[x.get("idref")] for x in root.iter() if _local(x.tag) == "itemref" and x.get("idref") in items]
    names = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(h))) for h in order]
    return _joined([web.read_page(z.read(n).decode("utf-8", "replace"))["text"] for n in names if n in z.namelist()])


def _sheets(read) -> Callable[[bytes], str]:
    def text(data: bytes) -> str:
        out = []
        for name, rows in read(data).items():
            width = max((c + 1 for _, cells in rows for c in cells), default=0)
            table = [["" if cells.get(c) is None else str(cells[c]).replace("|", "\\|").replace("\n", " ") for c in range(width)] for _, cells in rows]
            out += [f"# {name}", web.markdown_table(table)] if table else []
        return _joined(out)

    return text


def _joined(blocks: list[str]) -> str:
    text = re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in blocks if b.strip())).strip()
    if not text:
        raise NoText
    return text


REGISTRY: list[Extractor] = [
    ("docx", ("docx",), docx), ("odt", ("odt",), odt), ("pptx", ("pptx",), pptx), ("epub", ("epub",), epub),
    ("xlsx", ("xlsx", "xlsm"), _sheets(delimited.read_xlsx)), ("ods", ("ods",), _sheets(delimited.read_ods)),
    ("html", ("html", "htm", "xhtml"), html), ("plain", ("txt", "md", "markdown", "csv", "tsv", "json", "xml", "py", "swift", "js", "ts", "java", "go", "rs", "c", "h", "cpp"), plain),
]


def extract(path: str, data: bytes, registry: list[Extractor] | None = None) -> tuple[str | None, str | None, str | None]:
    """(extractor, text, problem) of one file: the first extractor for its extension; the next only where that one finds no text."""
    kind, tried = path.rsplit(".", 1)[-1].lower() if "." in path else "", None
    for name, kinds, read in REGISTRY if registry is None else registry:
        if kind not in kinds:
            continue
        try:
            return name, read(data), None
        except NoText:
            tried = name
        except Exception as e:  # a broken file is that file's problem, not the job's
            return name, None, f"{type(e).__name__}: {e}"
    return tried, None, "no text" if tried else "no extractor"


def extracted(files: DataFrame, registry: list[Extractor] | None = None) -> DataFrame:
    """(path, extractor, text, problem) of every file (path, content)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = extract(path, content.as_py() or b"", registry)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, *found)], ["path", "extractor", "text", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, extractor string, text string, problem string")


def slide_chunks(files: DataFrame) -> DataFrame:
    """(path, slide, document): a chunk for each slide with a text, numbered from 1."""

    @F.pandas_udf("array<string>")
    def of(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: slides(bytes(c)))

    return files.select("path", F.posexplode(of("content")).alias("slide", "document")).where("document != ''").withColumn("slide", F.col("slide") + 1)
