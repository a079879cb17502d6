"""Web pages: text, metadata and links of HTML, URL normalisation, robots rules, sitemaps, crawling a stored web."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text of the page (fixed values).
IGNORED = ["script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "form", "iframe", "template", "figure"]
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote", "pre", "br", "hr", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
SCRIPTED_BELOW = 40  # characters of text under which a page is taken to be drawn by scripts


def without_ignored(html: Column) -> Column:
    """Ignored elements replaced by a line break each."""
    return reduce(lambda h, t: F.regexp_replace(h, rf"(?is)<{t}\b.*?</{t}\s*>", "\n"), IGNORED, F.regexp_replace(html, r"(?s)<!--.*?-->", ""))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def meta_description(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<meta[^>]*\bname\s*=\s*[\"']description[\"'][^>]*\bcontent\s*=\s*[\"'](.*?)[\"']", 1))


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<link[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*\bhref\s*=\s*[\"'](.*?)[\"']", 1)


def plain_text(html: Column) -> Column:
    """Text without tags: what matters for counting, not for reading."""
    bare = F.regexp_replace(F.regexp_replace(without_ignored(html), r"(?is)<title[^>]*>.*?</title>", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def drawn_by_scripts(html: Column) -> Column:
    return F.length(plain_text(html)) < SCRIPTED_BELOW


def hrefs(html: Column) -> Column:
    """Targets of links as written, distinct, in order; no fragments, scripts, mail or phone numbers."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), 1)
    clean = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"#.*$", ""))
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & ~F.lower(x).rlike(r"^(javascript|mailto|tel|data):")))


def normalised_url(url: Column) -> Column:
    """No fragment, scheme and host in lower case, no default port, a path at least."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[^:]+://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    rest = F.regexp_extract(bare, r"^[^:]+://[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, rest)).otherwise(bare)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, a leading www aside."""
    def host(u):
        return F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#:]*)", 1)), r"^www\.", "")

    return host(a) == host(b)


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.out, self.links, self.headings = base, 0, [], [], []
        self.heading, self.title, self.in_title, self.row, self.cell, self.table = None, "", False, None, None, None

    def handle_starttag(self, tag, attrs):
        if tag in IGNORED:
            self.skip += 1
        if self.skip:
            return
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag == "a":
            target = dict(attrs).get("href") or ""
            url = urljoin(self.base, target.split("#")[0]) if target.split("#")[0] else ""
            if re.match(r"https?://", url) and url not in self.links:
                self.links.append(url)
        elif tag == "li":
            self.out.append("\n- ")
        elif re.fullmatch("h[1-6]", tag):
            self.heading = (int(tag[1]), [])
            self.out.append("\n\n")
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in IGNORED and self.skip:
            self.skip -= 1
        elif self.skip:
            return
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.table.append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            self.out.append("\n" + markdown_table(self.table) + "\n")
            self.table = None
        elif self.heading and tag == f"h{self.heading[0]}":
            text = " ".join("".join(self.heading[1]).split())
            if text:
                self.headings.append((self.heading[0], text))
                self.out.append("\x01" * 0 + "#" * self.heading[0] + " " + text + "\n")
            self.heading = None
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        elif self.cell is not None:
            self.cell.append(data)
        elif self.heading:
            self.heading[1].append(data)
        else:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_table(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def read_page(html: str, base: str = "") -> dict:
    """title, text, headings (level, title, start) and absolute links of one page."""
    r = _Reader(base)
    r.feed(html)
    r.close()
    lines = [" ".join(x.split()) if not x.lstrip().startswith("|") else x for x in "".join(r.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    headings, at = [], 0
    for level, name in r.headings:
        found = text.find("#" * level + " " + name, at)
        if found >= 0:
            headings.append((level, name, found))
            at = found + 1
    return {"title": " ".join(r.title.split()), "text": text, "headings": headings, "links": r.links}


def read_pages(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, title, text, headings, links) of every page, in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        heading = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("start", pa.int32())]))
        for b in batches:
            found = [read_page(h or "", u or "") for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f["title"] for f in found], pa.string()), pa.array([f["text"] for f in found], pa.string()), pa.array([[{"level": a, "title": t, "start": s} for a, t, s in f["headings"]] for f in found], heading), pa.array([f["links"] for f in found], pa.list_(pa.string()))],
                ["page_id", "title", "text", "headings", "links"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url, html)
    return rows.mapInArrow(run, "page_id long, title string, text string, headings array<struct<level:int,title:string,start:int>>, links array<string>")


def robots_rules(text: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, pattern) of the group for an agent, else of the group for all."""
    groups: dict[str, list] = {}
    names: list[str] = []
    last = ""
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = names + [value.lower()] if last == "user-agent" else [value.lower()]
            for n in names:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow") and names and (value or key == "allow"):
            for n in names:
                groups[n].append((key == "allow", value))
        if key:
            last = key
    named = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(named, key=len)] if named else groups.get("*", [])


def robots_allows(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching rule decides, allow among equals; ``*`` is anything, ``$`` the end."""
    best = (-1, True)
    for allowed, pattern in rules:
        if not pattern:
            continue
        end = pattern.endswith("$")
        body = ".*".join(map(re.escape, pattern.rstrip("$").split("*")))
        if re.match(body + ("$" if end else ""), path):
            best = max(best, (len(pattern), allowed))
    return best[1]


def sitemap_urls(text: str) -> tuple[list[str], list[str]]:
    """(pages, further sitemaps) of an XML sitemap or index, or of a plain list."""
    if "<" not in text:
        return [x.strip() for x in text.splitlines() if re.match(r"https?://", x.strip())], []
    maps = re.findall(r"<sitemap>.*?<loc>\s*(.*?)\s*</loc>", text, re.S)
    pages = re.findall(r"<url>.*?<loc>\s*(.*?)\s*</loc>", text, re.S)
    return [p.replace("&amp;", "&") for p in pages], [m.replace("&amp;", "&") for m in maps]


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(url, depth): stored pages (url) reached from ``seeds`` (url) along ``links`` (url, target), breadth first.

    Each round joins the frontier with the links; what was reached before is
    dropped by an anti join.
    """
    known = pages.select(normalised_url(F.col("url")).alias("url")).distinct()
    edges = links.select(normalised_url(F.col("url")).alias("url"), normalised_url(F.col("target")).alias("target")).distinct()
    frontier = seeds.select(normalised_url(F.col("url")).alias("url")).distinct().join(known, "url", "left_semi")
    reached = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct()
        frontier = step.join(known, "url", "left_semi").join(reached, "url", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(d)))
    return reached


def decoded(data: bytes, declared: str | None = None) -> str:
    """A page's text by the declared charset, a mark at its start, a meta tag, else UTF-8 or Windows-1251."""
    head = data[:2048].decode("latin-1")
    meta = re.search(r"charset\s*=\s*[\"']?([\w-]+)", head, re.I)
    for name in (declared, "utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else None, meta[1] if meta else None, "utf-8", "windows-1251"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
    return data.decode("latin-1")


def reflowed(lines: list[str]) -> str:
    """Lines of a page of print as paragraphs: hyphens at line ends joined if the whole word occurs, list items kept apart."""
    words = set(re.findall(r"\w+", " ".join(lines).lower()))
    out = ""
    for line in lines:
        s = line.strip()
        if not s:
            out = out.rstrip() + "\n\n"
        elif re.match(r"([-*•–]|\d+[.)])\s", s):
            out = (out if out.endswith("\n\n") else out.rstrip() + "\n") + s + " "
        elif out.endswith("- ") and out[-3:-2].isalpha():
            stem = re.search(r"(\w+)- $", out)[1]
            first = re.match(r"\w*", s)[0]
            out = out[:-2] + s + " " if (stem + first).lower() in words or first.islower() else out[:-1] + s + " "
        else:
            out += s + " "
    return re.sub(r"\n{3,}", "\n\n", out).strip()
