"""Queries of scans, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import filters
from ..sources import collections as C
from ..sources import delimited as D
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


def _where(spec):
    return lambda s, d: B.labelled(s, d).where(filters.where(spec)).select("id")


L = f"WITH {B.LABELLED_SQL} "

for _name, _spec, _pred in [
    ("f01_eq", {"lang": "de"}, "lang = 'de'"),
    ("f01_eq_missing", {"quality": {"$eq": 1}}, "quality = 1"),
    ("f02_ne", {"quality": {"$ne": 1}}, "quality IS NULL OR quality <> 1"),
    ("f03_gt_lte", {"$and": [{"n_chars": {"$gt": 500}}, {"n_chars": {"$lte": 2000}}]}, "n_chars > 500 AND n_chars <= 2000"),
    ("f03_gte_lt", {"$and": [{"n_chars": {"$gte": 100}}, {"n_chars": {"$lt": 400}}]}, "n_chars >= 100 AND n_chars < 400"),
    ("f04_in", {"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')"),
    ("f05_nin", {"toxic": {"$nin": [1]}}, "toxic IS NULL OR toxic NOT IN (1)"),
    ("f06_tree", {"$or": [{"$and": [{"lang": "es"}, {"toxic": {"$ne": 1}}]}, {"$and": [{"quality": 0}, {"source": {"$in": ["src1", "src2", "src0"]}}]}]}, "(lang = 'es' AND (toxic IS NULL OR toxic <> 1)) OR (quality = 0 AND source IN ('src1', 'src2', 'src0'))"),
    ("f07_implicit_and", '{"lang": "en", "quality": 1}', "lang = 'en' AND quality = 1"),
]:
    Q[_name] = _where(_spec)
    SQL[_name] = f"{L} SELECT id FROM labelled WHERE {_pred}"

for _name, _spec, _pred in [
    ("f08_contains", {"$contains": "the "}, "contains(document, 'the ')"),
    ("f08_not_contains", {"$not_contains": "The"}, "NOT contains(document, 'The')"),
    ("f09_regex", {"$regex": T.alternation(["tion", "éau"])}, r"regexp_matches(document, '(?i)(^|[^\p{L}\p{N}_])(tion|éau)')"),
    ("f10_text_logic", {"$or": [{"$contains": "ß"}, {"$and": [{"$contains": "ñ"}, {"$not_contains": "ó"}]}]}, "contains(document, 'ß') OR (contains(document, 'ñ') AND NOT contains(document, 'ó'))"),
]:
    Q[_name] = (lambda spec: lambda s, d: B.table(s, d, "documents").where(filters.where_document(spec, F.col("text"))).select("doc_id"))(_spec)
    SQL[_name] = f"SELECT doc_id FROM documents WHERE {_pred.replace('document,', 'text,')}"


@add("f13_file_types", "SELECT page_id FROM pages WHERE lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([a-z]+)$', 1)) IN ('html', 'htm', 'xhtml', 'pdf')")
def _(s, d):
    ext = F.lower(F.regexp_extract(F.regexp_extract("url", "^[^?#]*", 0), r"\.([a-z]+)$", 1))
    return B.table(s, d, "pages").where(filters.file_types(["html", "pdf"], ext)).select("page_id")


@add("f14_case_variants", "SELECT doc_id FROM documents WHERE contains(text, 'tion') OR contains(text, 'Tion') OR contains(text, 'TION')")
def _(s, d):
    return B.table(s, d, "documents").where(T.contains_any(F.col("text"), T.case_variants("tion"))).select("doc_id")


@add("f15_projection", "SELECT doc_id, lang, source FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", "lang", "source")


@add("f16_preview", "SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END AS preview FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@add("f17_audit_filter", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup') AND contains(lower(event_type), 'sign')")
def _(s, d):
    from ..streaming.events import filtered_audit

    return filtered_audit(B.table(s, d, "events"), True, None, "SIGN", ["purchase", "signup"], "event_type").select("event_id")


@add("f18_folded_search", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'eau')")
def _(s, d):
    return B.table(s, d, "documents").where(F.contains(T.folded(F.col("text")), F.lit(T.fold_word("ÉAU")))).select("doc_id")


@add("f20_level_scope", "SELECT conv_id, turn FROM conversations WHERE turn <> 1")
def _(s, d):
    return B.table(s, d, "conversations").where(filters.level_scope("children", F.col("turn"))).select("conv_id", "turn")


@add("f21_minimum_length", "SELECT doc_id FROM documents WHERE length(text) >= 200")
def _(s, d):
    return B.table(s, d, "documents").where(F.length("text") >= 200).select("doc_id")


@add("f22_permissions", "SELECT doc_id FROM documents WHERE source IN (SELECT 'src' || r_regionkey FROM region)")
def _(s, d):
    allowed = B.table(s, d, "region").select(F.concat(F.lit("src"), "r_regionkey").alias("source"))
    return B.table(s, d, "documents").join(allowed, "source", "left_semi").select("doc_id")


@add("s01_page", "SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def _(s, d):
    return C.page(B.table(s, d, "documents").withColumnRenamed("doc_id", "id"), 100, 50, ["id", "lang"])


@add("s02_by_ids", "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def _(s, d):
    ids = B.table(s, d, "benchmark").select(F.col("item_id").alias("id"))
    return C.by_ids(B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), ids)


@add("s03_embeddings_by_ids", "SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::INT AS positive FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def _(s, d):
    ids = B.table(s, d, "benchmark").select(F.col("item_id").alias("id"))
    return C.by_ids(B.vectors(s, d), ids).select("id", F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@add("s04_count", "SELECT count(*) AS n FROM documents")
def _(s, d):
    return B.table(s, d, "documents").agg(F.count("*").alias("n"))


@add("s05_existing_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents)")
def _(s, d):
    return C.existing_ids(B.table(s, d, "documents").select(F.col("doc_id").alias("id")), B.table(s, d, "orders").select(F.col("o_custkey").alias("id")))


@add("s06_any", "SELECT count(*) > 0 AS found FROM documents WHERE lang = 'es'")
def _(s, d):
    return C.any_matching(B.table(s, d, "documents"), F.col("lang") == "es")


@add("s07_dimension", "SELECT len(embedding)::INT AS dimension FROM embeddings WHERE embedding IS NOT NULL LIMIT 1")
def _(s, d):
    return C.dimension(B.table(s, d, "embeddings"))


@add("s08_collections", "SELECT source AS collection, count(*) AS documents FROM documents GROUP BY 1")
def _(s, d):
    return B.table(s, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("documents"))


@add("s11_upsert", "SELECT doc_id AS id, CASE WHEN lang = 'de' THEN upper(source) ELSE source END AS source FROM documents UNION ALL SELECT -item_id - 1, 'new' FROM benchmark")
def _(s, d):
    old = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    new = old.where("lang = 'de'").select("id", F.upper("source").alias("source")).unionByName(B.table(s, d, "benchmark").select((-F.col("item_id") - 1).alias("id"), F.lit("new").alias("source")))
    return C.upserted(old.drop("lang"), new)


@add("s12_update", "SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN NULL ELSE d.lang END AS lang, CASE WHEN l.quality = 1 THEN 'good' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    old = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    gone = F.when(F.col("toxic") == 1, F.array(F.lit("lang"))).otherwise(F.array().cast("array<string>"))
    new = B.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").alias("source"), gone.alias("_removed"))
    return C.updated(old, new, "_removed")


@add("s13_delete", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return C.deleted(B.table(s, d, "documents").select(F.col("doc_id").alias("id")), B.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))


@add("s13_missing_ids", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)")
def _(s, d):
    return C.missing_ids(B.table(s, d, "documents").select(F.col("doc_id").alias("id")), B.table(s, d, "customer").select(F.col("c_custkey").alias("id")))


_WIRE = "strlen(doc_id::VARCHAR) + 2 + 1 + strlen(text) + 2 + (2 * length(text) - length(replace(text, '\"', '')) - length(replace(text, '\\', ''))) + 5 * (length(text) - length(regexp_replace(text, '[\\x00-\\x1f]', '', 'g'))) + 1 + 64 * 25 + 4"


@add("s14_batches", f"""WITH RECURSIVE z AS (SELECT doc_id, ({_WIRE})::BIGINT AS size FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM z WHERE size + 128 <= 30000),
r AS (SELECT doc_id, n, 1 AS held, 128 + size AS used, 0::BIGINT AS number FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, CASE WHEN r.held >= 20 OR r.used + o.size > 30000 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held >= 20 OR r.used + o.size > 30000 THEN 128 + o.size ELSE r.used + o.size END,
    CASE WHEN r.held >= 20 OR r.used + o.size > 30000 THEN r.number + 1 ELSE r.number END FROM r JOIN o ON o.n = r.n + 1)
SELECT doc_id AS id, number AS batch FROM r UNION ALL SELECT doc_id, NULL FROM z WHERE size + 128 > 30000""")
def _(s, d):
    rows = B.table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return C.batches(rows, 20, 30_000, C.record_bytes(F.col("id"), F.col("document"), F.lit(64))).select("id", "batch")


@add("s18_prepare", "SELECT p_partkey::VARCHAR AS id, trim(p_name) AS document, trim(p_brand) AS p_brand, trim(p_type) AS p_type FROM part WHERE trim(p_name) <> ''")
def _(s, d):
    return D.prepared(B.table(s, d, "part"), {"p_partkey": "id", "p_name": "text", "p_brand": "metadata", "p_type": "metadata"})


@add("s21_typed_cells", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^0\\d') THEN 'text' WHEN regexp_matches(t, '^-?\\d+(\\.\\d+)?$') THEN 'number' WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date' ELSE 'text' END AS kind FROM (SELECT unnest(string_split(line, ';')) AS t FROM (SELECT c_custkey || ';' || c_name || ';' || c_nationkey || ';' || CASE WHEN c_nationkey < 5 THEN '' ELSE '00' || c_nationkey END || ';2024-01-0' || (1 + c_nationkey % 9) AS line FROM customer))) GROUP BY kind")
def _(s, d):
    n = F.col("c_nationkey")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", n.cast("string"), F.when(n < 5, "").otherwise(F.concat(F.lit("00"), n.cast("string"))), F.concat(F.lit("2024-01-0"), (1 + n % 9).cast("string")))
    lines = B.table(s, d, "customer").select(F.col("c_custkey").alias("row_number"), line.alias("value"))
    return D.typed_cells(lines, ";").groupBy("kind").agg(F.count("*").alias("n"))


@add("s42_uncached", "SELECT sha256('m:' || t) AS key FROM (SELECT DISTINCT regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g') AS t FROM documents) WHERE sha256('m:' || t) NOT IN (SELECT sha256('m:' || regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g')) FROM documents WHERE lang = 'en')")
def _(s, d):
    docs = B.table(s, d, "documents")
    cache = docs.where("lang = 'en'").select(C.cache_key(F.lit("m"), F.col("text")).alias("key"))
    return C.uncached(docs.select("text"), cache, "m").select("key")


@add("s43_retention", "SELECT event_id AS id FROM (SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE used <= 60")
def _(s, d):
    rows = B.table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.length("props").alias("size"))
    return C.keep_newest(rows, "ts", "size", 60, F.expr("timestamp_ntz '2024-01-10'"), ["user_id"]).select("id")


@add("n01_fold", "SELECT doc_id, md5(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) AS folded FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", F.md5(T.folded(F.col("text")).cast("binary")).alias("folded"))


@add("n04_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


@add("n06_percentile_index", "SELECT conv_id, list_sort(list(length(text)))[round(0.9::DOUBLE * (count(*) - 1))::INT + 1] AS p90 FROM conversations GROUP BY conv_id")
def _(s, d):
    return B.table(s, d, "conversations").groupBy("conv_id").agg(V.percentile_at(F.collect_list(F.length("text")), 0.9).alias("p90"))


@add("n07_math", "SELECT doc_id, round(log2(n_chars + 1), 6) AS l2, round(ln(n_chars + 1), 6) AS l, round(sqrt(n_chars), 6) AS r, least(1.0, greatest(0.0, n_chars / 1000.0))::DOUBLE AS c FROM documents")
def _(s, d):
    n = F.col("n_chars")
    return B.table(s, d, "documents").select("doc_id", F.round(F.log2(n + 1), 6).alias("l2"), F.round(F.log(n + 1), 6).alias("l"), F.round(F.sqrt(n), 6).alias("r"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / 1000.0)).alias("c"))


@add("n08_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def _(s, d):
    t = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return B.table(s, d, "orders").select("o_orderkey", V.month_key(t).alias("month"), V.epoch(t).alias("seconds"))


@add("n09_excel_dates", "SELECT c_custkey, CASE WHEN c_custkey = 60 THEN NULL ELSE strftime(TIMESTAMP '1899-12-30' + to_days((c_custkey + CASE WHEN c_custkey < 60 THEN 1 ELSE 0 END)::INT), '%Y-%m-%d') END AS day FROM customer")
def _(s, d):
    return B.table(s, d, "customer").select("c_custkey", F.date_format(V.excel_date(F.col("c_custkey").cast("double")), "yyyy-MM-dd").alias("day"))


@add("n12_versions", "SELECT event_id, (event_id % 13) || '.' || (event_id % 7) AS version, (event_id % 13) * 100 + event_id % 7 > 506 AS newer FROM events")
def _(s, d):
    v = F.concat((F.col("event_id") % 13).cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string"))
    return B.table(s, d, "events").select("event_id", v.alias("version"), (V.version_key(v) > V.version_key(F.lit("5.6"))).alias("newer"))


@add("n14_json", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(s, d):
    return B.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@add("n15_tags", "SELECT source, count(DISTINCT lower(lang)) AS tags FROM documents GROUP BY source")
def _(s, d):
    docs = B.table(s, d, "documents").groupBy("source").agg(F.array_join(F.collect_set("lang"), " , ").alias("t"))
    return docs.select("source", F.size(T.tags(F.concat("t", F.lit(","), F.upper("t")))).cast("long").alias("tags"))


@add("n16_masking", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(bearer\\s+)[A-Za-z0-9._~+/=-]+', '\\1***', 'g'), '(?i)((?:api[_-]?key|token|password|secret)\\s*[=:]\\s*\"?)[^\\s\",;]+', '\\1***', 'g')) AS masked FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", F.md5(T.masked(F.col("text")).cast("binary")).alias("masked"))


@add("n17_maps", "SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS kept FROM documents")
def _(s, d):
    m = F.map_concat(F.create_map(F.lit("lang"), F.col("lang")), F.create_map(F.lit("source"), F.col("source")))
    return B.table(s, d, "documents").select("doc_id", F.size(F.map_keys(F.map_filter(m, lambda k, v: v != "en"))).alias("kept"))
