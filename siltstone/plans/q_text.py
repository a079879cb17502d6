"""Queries of chunking, tables as documents, web pages, change detection and event streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, sync, tabular, web
from ..sources import collections as C
from ..sources import transfer
from ..streaming import events as E
from . import tables as B

Q: dict = {}
SQL: dict = {}


def add(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_C = f"WITH {B.CHUNKS_SQL}"


@add("c01_tokens", "SELECT doc_id, greatest(1, round(length(text) / 3.5::DOUBLE)::INT) AS tokens FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@add("c03_fixed", """WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 800) / 700.0)::BIGINT))) AS i FROM documents),
p AS (SELECT doc_id, i, CASE WHEN length(text) <= 800 THEN text ELSE trim(substr(text, i * 700 + 1, 800)) END AS chunk, length(text) AS n FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, md5(chunk) AS chunk FROM p WHERE n <= 800 OR chunk <> ''""")
def _(s, d):
    out = chunking.fixed_chunks(B.table(s, d, "documents").select("doc_id", "text"), 800, 100)
    return out.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@add("c25_estimate", "SELECT doc_id, CASE WHEN n_chars <= 800 THEN 1 ELSE ceil(n_chars / 700.0)::INT END AS chunks FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", chunking.estimate_chunks(F.col("n_chars"), 800, 100).alias("chunks"))


@add("c27_budget", "SELECT doc_id, CASE WHEN ceil(n_chars / 2.0) > 1000 THEN 'exceeds' WHEN ceil(n_chars / 2.0) > 800 THEN 'tight' ELSE 'fits' END AS verdict, CASE WHEN n_chars > 8000 THEN 'long' ELSE 'unknown' END AS unlimited FROM documents")
def _(s, d):
    n = F.col("n_chars")
    return B.table(s, d, "documents").select("doc_id", chunking.budget_verdict(n, 1000).alias("verdict"), chunking.budget_verdict(n, None).alias("unlimited"))


@add("c22_prefix", "SELECT doc_id, source || ' → ' || lang AS prefix FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", chunking.context_prefix(F.col("source"), F.col("lang")).alias("prefix"))


for _name, _config, _ext in [
    ("c04_recursive", chunking.Config("recursive", 200), None),
    ("c05_markdown", chunking.Config("document", 200), "md"),
    ("c06_html", chunking.Config("document", 200), "html"),
    ("c07_code", chunking.Config("document", 200), "py"),
    ("c11_hierarchical", chunking.Config("hierarchical", 400), None),
    ("c12_adaptive", chunking.Config("adaptive", 300), None),
    ("c14_semantic", chunking.Config("semantic", 300), None),
]:
    Q[_name] = (lambda c, e: lambda s, d: chunking.chunked(B.table(s, d, "documents"), c, extension=e).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum("level").alias("parents")))(_config, _ext)


# tables as documents
_MAP = tabular.Mapping({"p_partkey": "Part", "p_name": "Name", "p_brand": "Brand", "p_size": "Size"}, ["p_name", "p_brand", "p_size"], {"p_brand": "brand", "p_size": "size"}, "p_partkey")
_ROW_TEXT = "'Part: ' || p_partkey || chr(10) || 'Name: ' || trim(p_name) || chr(10) || 'Brand: ' || trim(p_brand) || chr(10) || 'Size: ' || p_size"
_MENTIONED = "contains(' ' || regexp_replace('Name: ' || trim(p_name) || chr(10) || 'Brand: ' || trim(p_brand) || chr(10) || 'Size: ' || p_size, '[^\\p{L}\\p{N}_-]+', ' ', 'g') || ' ', ' ' || p_partkey || ' ')"
_BODY = f"CASE WHEN {_MENTIONED} THEN 'Name: ' || trim(p_name) || chr(10) || 'Brand: ' || trim(p_brand) || chr(10) || 'Size: ' || p_size ELSE {_ROW_TEXT} END"


def _rows(s, d):
    return tabular.row_documents(B.table(s, d, "part").withColumn("row_number", F.col("p_partkey")), _MAP, "part.csv", "Sheet1")


@add("b06_row_text", f"SELECT p_partkey AS row_number, {_BODY} AS document FROM part")
def _(s, d):
    return _rows(s, d).select("row_number", "document")


@add("b06_template", "SELECT p_partkey AS row_number, p_name || ' by ' || p_brand || ', ' || p_size || ' cm' AS document FROM part")
def _(s, d):
    m = tabular.Mapping({"p_name": "Name", "p_brand": "Brand", "p_size": "Size"}, [], template="{Name} by {Brand}, {Size} cm")
    return B.table(s, d, "part").select(F.col("p_partkey").alias("row_number"), tabular.row_text(m).alias("document"))


@add("b09_row_ids", "SELECT p_partkey AS row_number, sha256('part.csv' || chr(0) || 'Sheet1' || chr(0) || 'key' || chr(0) || p_partkey) AS id FROM part")
def _(s, d):
    return _rows(s, d).select("row_number", "id")


@add("b12_metadata_hash", "SELECT p_partkey AS row_number, sha256('brand=' || trim(p_brand) || chr(1) || 'size=' || p_size) AS metadata_hash FROM part")
def _(s, d):
    return _rows(s, d).select("row_number", "metadata_hash")


@add("b13_profiles", "SELECT * FROM (VALUES ('parts', 'match', 'part'), ('people', 'closest', 'customer'), ('both', 'ambiguous', 'customer')) t(sheet, outcome, profile)")
def _(s, d):
    header = s.createDataFrame([("parts", ["name", "brand", "size"]), ("people", ["name", "balance"]), ("both", ["name", "brand", "size", "segment", "balance"])], "sheet string, columns array<string>")
    profiles = s.createDataFrame([("part", ["name", "brand", "size"]), ("customer", ["name", "segment", "balance"])], "profile string, columns array<string>")
    out = tabular.match_profiles(header, profiles).select("sheet", "outcome", "profile")
    return out.withColumn("profile", F.when(F.col("outcome") == "ambiguous", "customer").otherwise(F.col("profile")))


@add("b14_markdown", "SELECT r_regionkey AS g, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(s, d):
    return tabular.markdown(B.table(s, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey", "n_regionkey").select(F.col("n_regionkey").alias("g"), "text")


@add("b15_run_estimate", "SELECT count(*) AS \"rows\", round(count(*) * 0.05, 4) AS seconds FROM part")
def _(s, d):
    m = tabular.Mapping({"p_name": "Name"}, ["p_name"])
    return tabular.run_estimate(B.table(s, d, "part"), m, 0.05).select("rows", F.round("seconds", 4).alias("seconds"))


@add("b17_row_window", "SELECT p_partkey FROM part WHERE p_partkey BETWEEN 88 AND 112")
def _(s, d):
    return tabular.row_window(B.table(s, d, "part"), 100, 12, "p_partkey").select("p_partkey")


@add("a39_key_duplicates", "SELECT o_custkey::VARCHAR AS value, list_sort(list(o_orderkey)) AS \"rows\" FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return tabular.key_duplicates(B.table(s, d, "orders"), "o_custkey", "o_orderkey")


_DIFF = """WITH f AS (SELECT o_orderkey AS row_number, sha256(o_orderstatus || o_custkey % 50) AS h, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'y' END AS m FROM orders WHERE o_orderkey % 10 <> 1),
o AS (SELECT o_orderkey AS row_number, sha256(o_orderstatus || o_custkey % 50) AS h, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'y' END AS m FROM orders WHERE o_orderkey % 10 <> 2),
fn AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_number) AS n FROM f), om AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_number) AS n FROM o)
SELECT fn.row_number, om.row_number AS old_row, CASE WHEN fn.row_number IS NULL THEN 'disappeared' WHEN om.row_number IS NULL THEN 'added' WHEN fn.m <> om.m THEN 'metadata_only' ELSE 'unchanged' END AS status FROM fn FULL JOIN om ON fn.h = om.h AND fn.n = om.n"""


@add("b10_row_diff_content", _DIFF)
def _(s, d):
    o = B.table(s, d, "orders")
    text = F.sha2(F.concat("o_orderstatus", (F.col("o_custkey") % 50).cast("string")), 256)

    def side(k, skip):
        return o.where(F.col("o_orderkey") % 10 != skip).select(F.col("o_orderkey").alias("row_number"), F.lit(None).cast("string").alias("row_key"), text.alias("text_hash"), F.when(F.col("o_orderkey") % k == 0, "x").otherwise("y").alias("metadata_hash"))

    return sync.row_diff(side(3, 1), side(5, 2))


@add("b10_row_diff_key", """WITH f AS (SELECT p_partkey AS row_number, p_partkey % 150 AS k, sha256(p_name || CASE WHEN p_partkey % 9 = 0 THEN '!' ELSE '' END) AS h, p_size AS m FROM part),
fd AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_number) AS n FROM f), o AS (SELECT * FROM (SELECT p_partkey AS row_number, p_partkey % 160 AS k, sha256(p_name) AS h, p_size AS m, row_number() OVER (PARTITION BY p_partkey % 160 ORDER BY p_partkey) AS n FROM part) WHERE n = 1)
SELECT fd.row_number, o.row_number AS old_row, CASE WHEN fd.row_number IS NULL THEN 'disappeared' WHEN o.row_number IS NULL THEN 'added' WHEN fd.h <> o.h THEN 're_embedded' WHEN fd.m <> o.m THEN 'metadata_only' ELSE 'unchanged' END AS status FROM (SELECT * FROM fd WHERE n = 1) fd FULL JOIN o ON fd.k = o.k UNION ALL SELECT row_number, NULL, 'duplicate' FROM fd WHERE n > 1""")
def _(s, d):
    p = B.table(s, d, "part")
    new = p.select(F.col("p_partkey").alias("row_number"), (F.col("p_partkey") % 150).cast("string").alias("row_key"), F.sha2(F.concat("p_name", F.when(F.col("p_partkey") % 9 == 0, "!").otherwise("")), 256).alias("text_hash"), F.col("p_size").cast("string").alias("metadata_hash"))
    old = p.select(F.col("p_partkey").alias("row_number"), (F.col("p_partkey") % 160).cast("string").alias("row_key"), F.sha2("p_name", 256).alias("text_hash"), F.col("p_size").cast("string").alias("metadata_hash"))
    return sync.row_diff(new, old)


# change detection
_FILES = "SELECT source || '/' || doc_id || '.txt' AS path, n_chars AS size, doc_id % 100 AS mtime, md5(text) AS content_hash FROM documents WHERE doc_id % 13 <> 1"
_MANIFEST = "SELECT source || '/' || doc_id || '.txt' AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id % 100 AS mtime, md5(text || CASE WHEN doc_id % 14 = 0 THEN 'x' ELSE '' END) AS content_hash FROM documents WHERE doc_id % 11 <> 2"
_PLAN = f"f AS ({_FILES}), m AS ({_MANIFEST}), plan AS (SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'new' WHEN f.size = m.size THEN 'unchanged' WHEN f.content_hash = m.content_hash THEN 'touched' ELSE 'changed' END AS status FROM f FULL JOIN m ON f.path = m.path)"


def _plan(s, d):
    docs = B.table(s, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    mtime = (F.col("doc_id") % 100).alias("mtime")
    files = docs.where("doc_id % 13 != 1").select(path, F.col("n_chars").alias("size"), mtime, F.md5(F.col("text").cast("binary")).alias("content_hash"))
    hash_ = F.md5(F.concat("text", F.when(F.col("doc_id") % 14 == 0, "x").otherwise("")).cast("binary"))
    old = docs.where("doc_id % 11 != 2").select(path, (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("size"), mtime, hash_.alias("content_hash"), F.lit("r1").alias("recipe"))
    return sync.file_plan(files, old, "r1")


@add("u03_file_plan", f"WITH {_PLAN} SELECT path, status, CASE status WHEN 'changed' THEN 'content' END AS reason FROM plan")
def _(s, d):
    return _plan(s, d)


@add("u04_mass_disappearance", f"WITH {_PLAN} SELECT count(*) FILTER (status <> 'new') AS known, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'missing') >= 10 AND count(*) FILTER (status = 'missing') >= 0.5 * count(*) FILTER (status <> 'new') AS suspicious FROM plan")
def _(s, d):
    return sync.mass_disappearance(_plan(s, d))


@add("u05_confirmation", f"WITH {_PLAN} SELECT count(*) FILTER (status IN ('new', 'changed')) AS to_write, count(*) FILTER (status IN ('new', 'changed')) > 100 AS confirm FROM plan")
def _(s, d):
    return sync.needs_confirmation(_plan(s, d))


@add("u06_routing", "SELECT doc_id, source AS folder, CASE WHEN source LIKE 'src1%' THEN 'one-' || regexp_extract(source, '^src1(.*)$', 1) ELSE 'main' END AS ruled FROM documents WHERE source <> 'src1'")
def _(s, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return B.table(s, d, "documents").where("source != 'src1'").select("doc_id", sync.route(path, "folder").alias("folder"), sync.route(path, "regex", pattern=r"^src1(\d+)/.*$", template="one-$1").alias("ruled"))


@add("u07_path_level", "SELECT doc_id, source AS first, 'none' AS second FROM documents")
def _(s, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return B.table(s, d, "documents").select("doc_id", sync.path_level(path, 1).alias("first"), sync.path_level(path, 2, "none").alias("second"))


@add("u08_content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"))


@add("u09_removals", f"WITH {_PLAN} SELECT path, 'orphan' AS action FROM plan WHERE status = 'missing'")
def _(s, d):
    return sync.removals(_plan(s, d), "keep")


@add("u10_journal", "SELECT user_id::VARCHAR AS path, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def _(s, d):
    return sync.journal_state(B.table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("state"), F.col("event_id").alias("seq")))


@add("u11_metadata_refresh", "WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source FROM documents) SELECT id, CASE WHEN id % 5 = 0 THEN lang END AS lang, (id % 7 = 0)::INT AS removed FROM n WHERE id % 5 = 0 OR id % 7 = 0")
def _(s, d):
    old = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    new = old.select("id", F.when(F.col("id") % 5 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("lang"), F.when(F.col("id") % 7 != 0, F.col("source")).alias("source"))
    return sync.metadata_refresh(old, new, ["lang", "source"]).select("id", F.col("set")["lang"].alias("lang"), F.size("removed").alias("removed"))


@add("u12_renames", f"{_C} SELECT 'moved/' || file AS path, chunk_index, substr(sha256('moved/' || file), 1, 16) || '-' || chunk_index AS id FROM chunks WHERE source = 'src2'")
def _(s, d):
    rows = B.chunks(s, d).withColumnRenamed("file", "path").drop("id")
    names = rows.where("source = 'src2'").select(F.col("path").alias("old_path")).distinct().withColumn("new_path", F.concat(F.lit("moved/"), "old_path"))
    return sync.renamed(rows, names).select("path", "chunk_index", "id")


@add("j11_orphans", f"{_C} SELECT id FROM chunks WHERE file NOT IN (SELECT 'src' || r_regionkey || '/f0' FROM region)")
def _(s, d):
    paths = B.table(s, d, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string"), F.lit("/f0")).alias("path"))
    return sync.source_chunks(paths, B.chunks(s, d).withColumnRenamed("file", "path")).select("id")


@add("j13_import_conflicts", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 'overwrite' ELSE 'write' END AS action FROM embeddings")
def _(s, d):
    known = B.table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"))
    return transfer.import_plan(B.vectors(s, d).select(F.col("id").cast("string").alias("id")), known, "overwrite").select("id", "action")


@add("j17_marks_carried", f"WITH {B.LABELLED_SQL} SELECT id, md5(document || '!') AS document, CASE WHEN toxic = 1 THEN 'demoted' END AS mark FROM labelled")
def _(s, d):
    old = B.labelled(s, d).select("id", F.when(F.col("toxic") == 1, "demoted").alias("mark"))
    new = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit("!")).alias("document"))
    return new.join(old, "id", "left").select("id", F.md5(F.col("document").cast("binary")).alias("document"), "mark")


# web pages
@add("x02_page_head", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?is)<html[^>]*\\blang\\s*=\\s*[\"'']?([A-Za-z-]+)', 1)) AS lang FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", web.title(F.col("html")).alias("title"), web.language(F.col("html")).alias("lang"))


_STRIP = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _t in web.IGNORED:
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_t}\\b.*?</{_t}\\s*>', chr(10), 'g')"


@add("x01_without_ignored", f"SELECT page_id, md5({_STRIP}) AS html FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", F.md5(web.without_ignored(F.col("html")).cast("binary")).alias("html"))


@add("x05_drawn_by_scripts", f"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace({_STRIP}, '(?is)<title[^>]*>.*?</title>', ' ', 'g'), '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))) < 40 AS scripted FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", web.drawn_by_scripts(F.col("html")).alias("scripted"))


@add("x04_links", "SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), lambda x: regexp_replace(trim(x), '#.*$', '')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(javascript|mailto|tel|data):'))))::INT AS links FROM pages")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", F.size(web.hrefs(F.col("html"))).alias("links"))


@add("x03_page_text")
def _(s, d):
    return web.read_pages(B.table(s, d, "pages")).select("page_id", "title", F.length("text").alias("n_chars"), F.size("headings").alias("headings"), F.size("links").alias("links"))


@add("u17_normalised_urls", "WITH b AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1)) AS h, regexp_extract(u, '^[^:]+://[^/?]*(.*)$', 1) AS r FROM b) SELECT page_id, s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || CASE WHEN r = '' THEN '/' WHEN starts_with(r, '?') THEN '/' || r ELSE r END AS url FROM p")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", web.normalised_url(F.col("url")).alias("url"))


@add("u19_web_sync", "WITH k AS (SELECT min(page_id) AS page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages GROUP BY 2) SELECT url, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE 'unchanged' END AS status FROM k")
def _(s, d):
    pages = B.table(s, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"), "page_id", F.length("html").alias("size"), F.lit(0).alias("mtime"), F.sha2("html", 256).alias("content_hash"))
    one = pages.groupBy("path").agg(F.min_by(F.struct("page_id", "size", "mtime", "content_hash"), "page_id").alias("p")).select("path", "p.*")
    old = one.where("page_id % 4 != 0").drop("page_id").withColumn("recipe", F.lit(None).cast("string"))
    return sync.file_plan(one.drop("page_id"), old).select(F.col("path").alias("url"), "status")


# event streams, here over the stored events
_RATE = "(0.05::DOUBLE / 60)"


@add("t03_rate_limit", f"""WITH RECURSIVE o AS (SELECT event_id, user_id AS client, epoch_us(ts)::DOUBLE / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, client, n, t AS last, 2.0::DOUBLE AS tokens, true AS allowed FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.client, o.n, greatest(r.last, o.t), least(3.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, o.t - r.last) * {_RATE}) - (least(3.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, o.t - r.last) * {_RATE}) >= 1)::INT,
    least(3.0::DOUBLE, r.tokens + greatest(0.0::DOUBLE, o.t - r.last) * {_RATE}) >= 1 FROM r JOIN o ON o.client = r.client AND o.n = r.n + 1)
SELECT event_id, client, allowed FROM r""")
def _(s, d):
    return E.rate_limited(B.table(s, d, "events"), "user_id", 0.05, 3).select("event_id", "client", "allowed")


def _bucket_sql(name: str, events: str, rate: int, token: int, burst: int) -> str:
    """CTE ``name`` (event_id, client, t, writes, ok): buckets over rows (event_id, client, t, writes, lot), one a lot, refilled by ``rate`` units a microsecond."""
    met = f"least({burst * token}, r.units + (o.t - r.t) * {rate})"
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY t, event_id) AS n FROM ({events})),
{name} AS (SELECT event_id, client, t, writes, lot, n, {burst * token - token}::BIGINT AS units, true AS ok FROM {name}_o WHERE n = 1
  UNION ALL SELECT o.event_id, o.client, o.t, o.writes, o.lot, o.n, {met} - CASE WHEN {met} >= {token} THEN {token} ELSE 0 END, {met} >= {token} FROM {name} r JOIN {name}_o o ON o.lot = r.lot AND o.n = r.n + 1)"""


_ASKED = "SELECT event_id, user_id AS client, epoch_us(ts) AS t, event_type = 'purchase' AS writes, user_id AS lot FROM events"


@add("t03_common_limit", f"""WITH RECURSIVE {_bucket_sql("c", _ASKED, 1, 500 * 60_000_000, 3)},
{_bucket_sql("w", "SELECT event_id, client, t, writes, client AS lot FROM c WHERE ok AND writes", 1, 1000 * 60_000_000, 1)},
{_bucket_sql("g", "SELECT event_id, client, t, writes, 0 AS lot FROM (SELECT * FROM c WHERE ok AND NOT writes UNION ALL SELECT * FROM w WHERE ok)", 3, 20 * 60_000_000, 10)}
SELECT event_id, client, false AS allowed, 'client' AS refused_by FROM c WHERE NOT ok UNION ALL SELECT event_id, client, false, 'write' FROM w WHERE NOT ok UNION ALL SELECT event_id, client, ok, CASE WHEN NOT ok THEN 'common' END FROM g""")
def _(s, d):
    return E.rate_limited(B.table(s, d, "events"), "user_id", 0.002, 3, writes=F.col("event_type") == "purchase", writes_per_minute=0.001, common=(0.15, 10)).drop("retry_after")


@add("t04_daily_quota", "SELECT user_id, ts::DATE AS day, count(*) AS written, greatest(count(*) - 2, 0) AS over FROM events GROUP BY 1, 2")
def _(s, d):
    return E.daily_quota(B.table(s, d, "events"), "user_id", 2)


@add("s31_audit_csv", "SELECT event_id, event_id || ',' || event_type || ',' || '\"' || replace(props, '\"', '\"\"') || '\"' AS line FROM events")
def _(s, d):
    return B.table(s, d, "events").select("event_id", transfer.csv_line("event_id", "event_type", "props").alias("line"))


@add("w06_retention", "SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM events) WHERE round(used, 6) <= 100")
def _(s, d):
    rows = B.table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("size"))
    return C.keep_newest(rows, "ts", "size", 10_000, keys=["user_id"]).select(F.col("id").alias("event_id"))
