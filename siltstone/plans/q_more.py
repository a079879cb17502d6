"""Queries of single operators that other modules use within larger ones, and of file, judge and header checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions import vectors as X
from ..operators import chunking, clustering, evaluation, inspection, knn, languages, locating, retrieval, sync, tabular, web
from ..sources import collections as C
from ..sources import delimited as D
from ..streaming import events as E
from . import q_analytics as A
from . import q_retrieval as R
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


_FOLD = "strip_accents(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))))"


# ---- pages, points and lists


@add("o01_page", "SELECT doc_id AS id, lang FROM documents WHERE n_chars > 200 ORDER BY doc_id LIMIT 50 OFFSET 100")
def _(s, d):
    rows = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return C.page(rows, 50, 100, where=F.col("n_chars") > 200).select("id", "lang")


@add("o04_top_k", "SELECT query_id, id, position FROM (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS position FROM events) WHERE position <= 5")
def _(s, d):
    hits = B.table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value")
    return retrieval.first_n(retrieval.ranked(hits, F.desc("value"), "id"), 5).select("query_id", "id", F.col("position").cast("long").alias("position"))


@add("o11_variant_difference", "SELECT DISTINCT event_type AS variant FROM events WHERE user_id % 2 = 0 EXCEPT SELECT event_type FROM events WHERE user_id % 3 = 0 AND event_type <> 'view'")
def _(s, d):
    e = B.table(s, d, "events").select(F.col("event_type").alias("variant"), "user_id")
    return evaluation.variants(e.where("user_id % 2 = 0"), e.where("user_id % 3 = 0 AND variant != 'view'")).where("side = 'before'").select("variant")


_FILES = f"WITH {B.CHUNKS_SQL}, c AS (SELECT *, substr(sha256(file), 1, 16) AS file_id FROM chunks)"


def _files(s, d):
    return B.chunks(s, d).withColumn("file_id", C.fingerprint(F.col("file")))


@add("o03_get_file", f"{_FILES} SELECT id, chunk_index FROM c WHERE file_id = substr(sha256('src1/f0'), 1, 16) ORDER BY chunk_index, id LIMIT 40 OFFSET 2")
def _(s, d):
    file_id = s.range(1).select(C.fingerprint(F.lit("src1/f0"))).first()[0]
    return C.file_chunks(_files(s, d), file_id=file_id, limit=40, offset=2).select("id", "chunk_index")


@add("o03_similar_files", f"WITH {B.CHUNKS_SQL}, n AS (SELECT file, count(*) AS n, min(regexp_extract(file, '[^/]*$') <> 'f0') AS part FROM chunks WHERE contains(regexp_extract(file, '[^/]*$'), 'f0') GROUP BY file) SELECT file, n FROM n ORDER BY part, file LIMIT 5")
def _(s, d):
    return C.similar_files(B.chunks(s, d), "elsewhere/F0")


@add("u15_path_repairs", f"{_FILES} SELECT id, file AS source_file, file_id FROM c WHERE id % 3 <> 0")
def _(s, d):
    kept = F.when(F.col("id") % 3 == 0, F.col("file_id")).when(F.col("id") % 3 == 1, F.lit("0" * 16))
    return C.path_repairs(_files(s, d).select("id", F.col("file").alias("source_file"), kept.alias("file_id")))


@add("f19_collections_named", "SELECT DISTINCT 'Été_' || source AS name FROM documents WHERE contains(strip_accents(lower(trim('Été_' || source))), 'ete_src1')")
def _(s, d):
    names = B.table(s, d, "documents").select(F.concat(F.lit("Été_"), "source").alias("name")).distinct()
    return C.named(names, " éTE_SRC1 ")


@add("f12_saved_filters", "WITH n AS (SELECT event_type AS collection, 'f' || user_id % 5 AS name, event_id, '{\"value\":' || event_id || '}' AS filter FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY collection, name ORDER BY event_id DESC) AS k FROM n) SELECT collection, name, filter FROM l WHERE k = 1")
def _(s, d):
    e = B.table(s, d, "events").select(F.col("event_type").alias("collection"), F.concat(F.lit(" f"), F.col("user_id") % 5, F.lit(" ")).alias("name"), F.concat(F.lit('{"value":'), "event_id", F.lit("}")).alias("filter"), F.col("event_id").alias("saved_at"))
    return C.with_saved(e.where("saved_at % 2 = 0"), e.where("saved_at % 2 = 1")).select("collection", "name", "filter")


# ---- files and findings


@add("a08_substituted", "SELECT source || '/f' || (doc_id // 200) AS file, string_agg(DISTINCT 'asked for ' || lang, '; ' ORDER BY 'asked for ' || lang) AS notes FROM documents WHERE doc_id % 7 = 0 AND lang IS NOT NULL GROUP BY 1")
def _(s, d):
    note = F.when(F.col("id") % 7 == 0, F.concat(F.lit("asked for "), "lang"))
    return inspection.substituted(B.chunks(s, d).withColumn("chunk_note", note))


@add("a08_gone_from_disk", f"WITH {B.CHUNKS_SQL} SELECT file, count(*) AS n FROM chunks WHERE source <> 'src2' AND hash_is_odd(file) GROUP BY file".replace("hash_is_odd(file)", "length(file) % 2 = 1"))
def _(s, d):
    chunks = B.chunks(s, d)
    listing = chunks.where("source != 'src2' AND length(file) % 2 = 0").select("source", "file").distinct()
    # a source whose files all went still was listed
    listed = chunks.where("source != 'src2'").select("source").distinct().withColumn("file", F.lit("readme"))
    return inspection.gone_from_disk(chunks, listing.unionByName(listed)).groupBy("file").agg(F.count("*").alias("n"))


@add("j12_rows_without_files", f"WITH {B.CHUNKS_SQL} SELECT id FROM chunks WHERE source IN (SELECT source FROM chunks WHERE id % 400 = 0) AND file NOT IN (SELECT file FROM chunks WHERE id % 400 = 0)")
def _(s, d):
    chunks = B.chunks(s, d)
    return inspection.gone_from_disk(chunks, chunks.where("id % 400 = 0").select("source", "file").distinct()).select("id")


# ---- evaluation


for _name, _metric in (("a12_recall", "recall"), ("a13_mrr", "mrr"), ("a14_ndcg", "ndcg")):
    Q[_name] = (lambda m: lambda s, d: A.Q["a11_metrics"](s, d).where(F.col("metric") == m).drop("metric"))(_metric)
    SQL[_name] = f"SELECT variant, k, value FROM ({A.SQL['a11_metrics']}) WHERE metric = '{_metric}'"


@add("a20_median_lengths", f"WITH {R._knn_sql(k=20)}, t AS (SELECT CASE WHEN position <= 10 THEN 'near' ELSE 'far' END AS variant, length(text) AS n FROM hits JOIN documents ON id = doc_id WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n) AS k, count(*) OVER (PARTITION BY variant) AS c FROM t) SELECT variant, n AS median FROM o WHERE k = c // 2 + 1")
def _(s, d):
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluation.median_lengths(R._hits(s, d, 20).join(docs, "id").withColumn("variant", F.when(F.col("position") <= 10, "near").otherwise("far")))


@add("a20_length_caveat", "WITH m AS (SELECT lang AS variant, list_sort(list(length(text)))[count(*) // 2 + 1] AS median FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND (lang <> 'en' OR doc_id % 2 = 0 OR length(text) > 1500) GROUP BY 1), e AS (SELECT arg_min(variant, (median, variant)) AS shortest, min(median) AS low, arg_max(variant, (median, variant)) AS longest, max(median) AS high, count(*) AS n FROM m) SELECT shortest, longest, 'median lengths from ' || low || ' to ' || high || ': longer texts contain a fragment more often' AS caveat FROM e WHERE n > 1 AND low > 0 AND high >= 1.01 * low")
def _(s, d):
    docs = B.table(s, d, "documents").where("lang is not null and (lang != 'en' or doc_id % 2 = 0 or length(text) > 1500)").select(F.col("lang").alias("variant"), "text")
    return evaluation.length_caveat(evaluation.median_lengths(docs), 1.01)


@add("a23_judge_coverage", f"WITH {R._knn_sql()}, g AS (SELECT h.query_id, h.id, CASE WHEN h.id % 5 = 0 THEN NULL WHEN h.label = 1 THEN 'relevant' WHEN h.label < 5 THEN 'partial' ELSE 'irrelevant' END AS grade FROM hits h) SELECT count(*) AS hits, count(grade) AS judged, count(*) - count(grade) AS \"left\", count(*) FILTER (grade = 'relevant') AS relevant, count(*) FILTER (grade = 'partial') AS partial, count(*) FILTER (grade = 'irrelevant') AS irrelevant FROM g")
def _(s, d):
    hits = R._hits(s, d).withColumn("variant", F.lit("v"))
    grade = F.when(F.col("label") == 1, "relevant").when(F.col("label") < 5, "partial").otherwise("irrelevant")
    told = hits.where("id % 5 != 0").join(B.vectors(s, d).select("id", "label"), "id").select("query_id", "variant", "id", grade.alias("grade"))
    return evaluation.judge_coverage(hits, told)


_STRICT = f"""{A._GRADED}, marked AS (SELECT query_id, bool_or(gain > 0) AS answerable FROM truth WHERE query_id % 400 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT query_id, false FROM truth WHERE query_id % 400 = 0),
g AS (SELECT h.query_id, h.variant, h.position, h.id, CASE WHEN h.id % 13 = 0 THEN 0.0 ELSE h.gain END AS gain, d.n_chars, m.answerable FROM graded h JOIN marked m USING (query_id) JOIN documents d ON h.id = d.doc_id),
per AS (SELECT query_id, variant, answerable, coalesce(1 / min(position) FILTER (gain = 1), 0)::DOUBLE AS rr, coalesce(max((position = 1 AND gain > 0)::INT), 0) AS hit_1, coalesce(max((position <= 3 AND gain > 0)::INT), 0) AS hit_3, count(*) FILTER (position <= 3 AND gain = 0) AS junk_3, count(*) FILTER (position <= 5 AND n_chars < 200) AS short_5, count(*) FILTER (gain IS NULL) AS unmarked FROM g GROUP BY 1, 2, 3)"""


def _strict(s, d):
    hits, truth, _ = A._evaluated(s, d)
    marked = truth.groupBy("query_id").agg(F.bool_or((F.col("gain") > 0) & (F.col("query_id") % 400 != 0)).alias("answerable"))
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return evaluation.strict(hits.join(docs, "id").withColumn("gain", F.when(F.col("id") % 13 == 0, 0.0).otherwise(F.col("gain"))), marked)


@add("a31_strict_relevance", f"WITH {_STRICT} SELECT variant, round(avg(rr) FILTER (answerable), 6) AS mrr, round(avg(hit_1) FILTER (answerable), 6) AS hit_1, round(avg(hit_3) FILTER (answerable), 6) AS hit_3, round(avg(junk_3), 6) AS junk_3, round(avg(short_5), 6) AS short_5, round(avg(unmarked), 6) AS unmarked FROM per GROUP BY variant")
def _(s, d):
    return evaluation.strict_summary(_strict(s, d)).select("variant", *[F.round(c, 6).alias(c) for c in ("mrr", "hit_1", "hit_3", "junk_3", "short_5", "unmarked")])


@add("a31_pairwise", f"WITH {_STRICT} SELECT a.variant, count(*) FILTER (a.rr > coalesce(b.rr, 0)) AS better, count(*) FILTER (a.rr < coalesce(b.rr, 0)) AS worse, count(*) FILTER (a.rr = coalesce(b.rr, 0)) AS same FROM per a LEFT JOIN per b ON a.query_id = b.query_id AND b.variant = 'near' WHERE a.variant <> 'near' AND a.answerable GROUP BY a.variant")
def _(s, d):
    return evaluation.pairwise(_strict(s, d), "near")


@add("a32_rules", f"WITH {_STRICT}, o AS (SELECT n.query_id, n.rr AS \"on\", f.rr AS off, len(string_split(b.text, ' ')) AS words FROM per n JOIN per f ON n.query_id = f.query_id AND n.variant = 'near' AND f.variant = 'far' AND n.answerable JOIN documents b ON b.doc_id = n.query_id) SELECT 'always' AS rule, round(avg(\"on\"), 6) AS value FROM o UNION ALL SELECT 'never', round(avg(off), 6) FROM o UNION ALL SELECT 'short', round(avg(CASE WHEN words <= 100 THEN \"on\" ELSE off END), 6) FROM o")
def _(s, d):
    per = _strict(s, d).where("answerable")
    on, off = per.where("variant = 'near'").select("query_id", F.col("rr").alias("on")), per.where("variant = 'far'").select("query_id", F.col("rr").alias("off"))
    text = B.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.size(F.split("text", " ")).alias("words"))
    return evaluation.simulated(on.join(off, "query_id").join(text, "query_id"), {"always": F.lit(True), "never": F.lit(False), "short": F.col("words") <= 100}).select("rule", F.round("value", 6).alias("value"))


# ---- stages of retrieval


@add("r09_fusion_stage", f"WITH {R._knn_sql(k=20)}, l AS (SELECT query_id, id, position, 0 AS list FROM hits UNION ALL SELECT query_id, id, 21 - position, 1 FROM hits WHERE label % 2 = 0), f AS (SELECT query_id, id, sum(1.0::DOUBLE / (10 + position)) AS score, count(*) AS lists FROM l GROUP BY 1, 2) SELECT query_id, id, lists, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relevance FROM f")
def _(s, d):
    hits = R._hits(s, d, 20)
    back = hits.join(B.vectors(s, d).where("label % 2 = 0").select("id"), "id").withColumn("position", 21 - F.col("position"))
    return retrieval.fuse([(hits, 1.0), (back, 1.0)], 10).select("query_id", "id", F.size("placements").cast("long").alias("lists"), F.round("relevance", 6).alias("relevance"))


@add("j03_text_and_vector", f"WITH {R._knn_sql(k=20)}, t AS (SELECT vec_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY vec_id ORDER BY n_chars, doc_id) AS position FROM embeddings JOIN documents ON vec_id % 100 = 0 AND doc_id % 50 = vec_id // 100 % 50), l AS (SELECT query_id, id, position, true AS near FROM hits UNION ALL SELECT query_id, id, position, false FROM t WHERE position <= 15) SELECT query_id, id, bool_or(near) AS near, bool_or(NOT near) AS text FROM l GROUP BY 1, 2")
def _(s, d):
    q = B.vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), (F.floor(F.col("id") / 100) % 50).alias("part"))
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", (F.col("doc_id") % 50).alias("part"))
    text = retrieval.first_n(retrieval.ranked(q.join(docs, "part"), "n_chars", "id"), 15)
    fused = retrieval.fuse([(R._hits(s, d, 20), 1.0), (text, 1.0)])
    return fused.select("query_id", "id", F.exists("placements", lambda p: p["list"] == 0).alias("near"), F.exists("placements", lambda p: p["list"] == 1).alias("text"))


@add("r15_promoted", f"WITH {R._knn_sql()} SELECT h.query_id, h.id, md5(p.text) AS parent FROM hits h LEFT JOIN documents p ON p.doc_id = h.id // 4 * 4 AND p.doc_id % 8 = 0")
def _(s, d):
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    hits = R._hits(s, d).join(docs, "id", "left").withColumn("parent_id", F.floor(F.col("id") / 4) * 4)
    return retrieval.promote(hits, docs.where("id % 8 = 0"), "both").select("query_id", "id", F.md5(F.col("parent_document").cast("binary")).alias("parent"))


@add("r16_context", f"""WITH {R._knn_sql()}, {B.CHUNKS_SQL}, h AS (SELECT h.query_id, h.id, c.file, c.chunk_index FROM hits h JOIN chunks c USING (id))
SELECT h.query_id, h.id, count(n.id) AS n FROM h LEFT JOIN chunks n ON n.file = h.file AND abs(n.chunk_index - h.chunk_index) = 1 AND (h.query_id, n.id) NOT IN (SELECT query_id, id FROM hits) GROUP BY 1, 2""")
def _(s, d):
    chunks = B.chunks(s, d)
    hits = R._hits(s, d).join(chunks.select("id", "file", "chunk_index"), "id")
    return retrieval.in_context(hits, chunks, 1).select("query_id", "id", F.coalesce(F.size("context"), F.lit(0)).cast("long").alias("n"))


@add("r18_cross_encoder", f"WITH {R._knn_sql()}, v AS (SELECT query_id, id, position, CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN 1.0::DOUBLE WHEN label = 2 THEN 0.0 ELSE label / 10.0::DOUBLE END AS score FROM hits) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, position) AS position FROM v")
def _(s, d):
    answer = F.when(F.col("label") == 0, "perhaps").when(F.col("label") == 1, "Да, it is").when(F.col("label") == 2, "no").otherwise(F.format_string("score: %.1f", F.col("label") / 10))
    told = R._hits(s, d).join(B.vectors(s, d).select("id", "label"), "id").select("query_id", "id", retrieval.parsed_score(answer).alias("score"))
    return retrieval.reorder(R._hits(s, d), told, 10).select("query_id", "id", "position")


@add("r25_changed_nothing", "SELECT count(*) = 0 AS unchanged FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def _(s, d):
    docs = B.table(s, d, "documents")
    stage = docs.agg(F.count("*").alias("rows_in"), F.count_distinct("text").alias("rows_out")).select(F.lit("collapse").alias("stage"), F.lit(True).alias("ran"), "rows_in", "rows_out")
    return retrieval.changed_nothing(stage)


@add("w03_regrouped", f"WITH {R._knn_sql()} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY label % 3, position) AS position FROM hits")
def _(s, d):
    return retrieval.regrouped(R._hits(s, d).join(B.vectors(s, d).select("id", "label"), "id"), F.col("label") % 3).select("query_id", "id", "position")


@add("w01_positions", "SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def _(s, d):
    return retrieval.ranked(B.table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice"), F.desc("o_totalprice"), "id").select("query_id", "id", "position")


@add("w02_first_of_each", "SELECT query_id, id FROM (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def _(s, d):
    hits = B.table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("event_id").alias("position"), F.col("event_type").alias("parent_id"))
    return retrieval.collapse_parents(hits).select("query_id", "id")


# ---- vectors


@add("v05_similarity", f"WITH {R._knn_sql(k=30)} SELECT query_id, id, round(least(1.0, greatest(0.0, 1 - distance)), 6) AS similarity FROM hits")
def _(s, d):
    return R._hits(s, d, 30).select("query_id", "id", F.round(X.similarity(F.col("distance")), 6).alias("similarity"))


@add("v07_window_mean", "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[64]::DOUBLE AS y FROM embeddings) SELECT vec_id, round(avg(x) OVER w, 6) AS first, round(avg(y) OVER w, 6) AS last FROM e WINDOW w AS (PARTITION BY vec_id // 100 ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def _(s, d):
    around = W.partitionBy(F.floor(F.col("id") / 100)).orderBy("id").rowsBetween(-1, 1)
    rows = B.vectors(s, d).withColumn("near", X.mean(F.collect_list("embedding").over(around), 64))
    return rows.select(F.col("id").alias("vec_id"), F.round(F.col("near")[0], 6).alias("first"), F.round(F.col("near")[63], 6).alias("last"))


@add("j07_vectors_of_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    return C.by_ids(B.vectors(s, d), B.table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))).select("id", "label")


# ---- lines, languages and values


@add("x09_list_markers", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT -doc_id - 1, doc_id || CASE doc_id % 4 WHEN 0 THEN '. a' WHEN 1 THEN ') a' WHEN 2 THEN ' a' ELSE '.2 a' END FROM documents UNION ALL SELECT -doc_id - 1, '- ' || lang FROM documents UNION ALL SELECT -doc_id - 1, '-' || lang FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[•●○◦▪▫‣·§–—−]') OR regexp_matches(line, '^[-+*] ') OR regexp_matches(line, '^\\p{N}[\\p{N}.]{0,10}\\)') OR (regexp_matches(line, '^\\p{N}[\\p{N}.]{0,10} ') AND regexp_matches(line, '^\\p{N}+\\.'))) AS markers FROM l GROUP BY 1")
def _(s, d):
    docs = B.table(s, d, "documents")
    own = F.when(F.col("doc_id") % 4 == 0, ". a").when(F.col("doc_id") % 4 == 1, ") a").when(F.col("doc_id") % 4 == 2, " a").otherwise(".2 a")
    made = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.explode(F.array(F.concat(F.col("doc_id").cast("string"), own), F.concat(F.lit("- "), "lang"), F.concat(F.lit("-"), "lang"))).alias("line"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).unionByName(made)
    return lines.groupBy("doc_id").agg(F.count_if(T.list_marker(F.col("line"))).alias("markers"))


@add("x11_table_lines", "WITH l AS (SELECT p_partkey, unnest([' | ' || p_name || ' | ' || p_brand || ' |  ', '| --- |:---:|', '|  |', '| a | --- |', p_name]) AS line FROM part) SELECT p_partkey, count(*) FILTER (starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND length(trim(line)) > 2) AS \"rows\", count(*) FILTER (regexp_matches(trim(line), '^\\|([ ]*[-:]+[ ]*\\|)+$')) AS separators FROM l GROUP BY 1")
def _(s, d):
    bar = F.lit("|")
    lines = B.table(s, d, "part").select("p_partkey", F.explode(F.array(F.concat(F.lit(" | "), "p_name", F.lit(" | "), "p_brand", F.lit(" |  ")), F.lit("| --- |:---:|"), F.concat(bar, F.lit("  "), bar), F.lit("| a | --- |"), F.col("p_name"))).alias("line"))
    return lines.groupBy("p_partkey").agg(F.count_if(T.table_row(F.col("line"))).alias("rows"), F.count_if(T.table_separator(F.col("line"))).alias("separators"))


@add("x07_language", r"""WITH d AS (SELECT doc_id, lang, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}]+')), lambda w: w <> '') AS ws, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM documents),
t AS (SELECT lang, unnest(ws) AS w FROM d WHERE lang IS NOT NULL AND doc_id % 5 <> 0), v AS (SELECT w FROM t GROUP BY w ORDER BY count(*) DESC, w LIMIT 2000),
n AS (SELECT lang, count(*) AS docs FROM d WHERE lang IS NOT NULL AND ws IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1),
m AS (SELECT v.w, n.lang, ln((count(t.w) + 1)::DOUBLE / (any_value(n.docs) + 2)) AS weight FROM v CROSS JOIN n LEFT JOIN t ON t.w = v.w AND t.lang = n.lang GROUP BY 1, 2),
s AS (SELECT doc_id, m.lang, sum(weight) AS score FROM (SELECT doc_id, unnest(ws) AS w FROM d WHERE letters >= 12) x JOIN m ON m.w = x.w GROUP BY 1, 2),
b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS place FROM s)
SELECT d.doc_id, b.lang FROM d LEFT JOIN b ON d.doc_id = b.doc_id AND place = 1""")
def _(s, d):
    docs = B.table(s, d, "documents").select("doc_id", F.col("text").alias("document"), "lang")
    return languages.guess(docs, languages.learn(docs.where("doc_id % 5 != 0"), most_words=2000), "doc_id")


@add("n02_capitalised", "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS name FROM part")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", T.capitalised(F.col("p_name")).alias("name"))


@add("n03_escaped", "SELECT doc_id, regexp_matches(text, '(?i)[еeё]?t\\. ') AS found FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select("doc_id", F.col("text").rlike(r"(?i)[еeё]?" + T.escaped("t. ")).alias("found"))


@add("n11_letters", "SELECT p_partkey, chr(65 + (p_partkey % 26)::INT) AS one, chr(65 + ((p_partkey % 676) // 26)::INT) || chr(65 + (p_partkey % 26)::INT) AS two FROM part")
def _(s, d):
    letters = F.array(*[F.lit(V.column_letters(i)) for i in range(26)])
    double = F.array(*[F.lit(V.column_letters(26 + i)) for i in range(676)])
    return B.table(s, d, "part").select("p_partkey", letters[(F.col("p_partkey") % 26).cast("int")].alias("one"), double[(F.col("p_partkey") % 676).cast("int")].alias("two"))


# ---- tables and files


@add("j10_row_diff", """WITH f AS (SELECT p_partkey AS row_number, p_size::VARCHAR AS t, p_brand AS m FROM part WHERE p_partkey % 7 <> 0), o AS (SELECT p_partkey + 100000 AS row_number, p_size::VARCHAR AS t, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END AS m FROM part WHERE p_partkey % 5 <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY row_number) AS n FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY row_number) AS n FROM o)
SELECT a.row_number, b.row_number AS old_row, CASE WHEN a.row_number IS NULL THEN 'disappeared' WHEN b.row_number IS NULL THEN 'added' WHEN a.m IS DISTINCT FROM b.m THEN 'metadata_only' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.t = b.t AND a.n = b.n""")
def _(s, d):
    part = B.table(s, d, "part").select(F.col("p_partkey").alias("row_number"), F.lit(None).cast("string").alias("row_key"), F.col("p_size").cast("string").alias("text_hash"), F.col("p_brand").alias("metadata_hash"))
    other = F.when(F.col("row_number") % 3 == 0, "other").otherwise(F.col("metadata_hash"))
    old = part.where("row_number % 5 != 0").withColumn("metadata_hash", other).withColumn("row_number", F.col("row_number") + 100_000)
    return sync.row_diff(part.where("row_number % 7 != 0"), old)


@add("b01_sheet_modes", "SELECT p_partkey AS sheet, CASE WHEN p_partkey % 5 = 0 THEN 'data_table' ELSE 'document' END AS mode, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN 1 END AS header, ['rows of one kind', 'no header row', 'mixed columns', 'one column', 'no rows'][1 + p_partkey % 5] AS reason FROM part")
def _(s, d):
    way = F.col("p_partkey") % 5
    odd = F.when(way == 2, True).otherwise(False)

    def cell(row, col, kind, value):
        return F.struct(F.lit(row).cast("long").alias("row_number"), F.lit(col).alias("col"), kind.alias("kind"), value.cast("string").alias("value"))

    text, number = F.lit("str"), F.lit("int")
    cells = F.array(
        cell(1, 0, text, F.lit("Name")), cell(1, 1, F.when(way == 1, number).otherwise(text), F.lit("7")), cell(2, 0, text, F.col("p_name")), cell(2, 1, number, F.col("p_size")),
        cell(3, 0, F.when(odd, number).otherwise(text), F.col("p_partkey")), cell(3, 1, F.when(odd, text).otherwise(number), F.col("p_size")))
    kept = F.filter(cells, lambda c: ((way != 3) | (c["col"] == 0)) & ((way != 4) | (c["row_number"] == 1)))
    rows = B.table(s, d, "part").select(F.lit("f").alias("path"), F.col("p_partkey").alias("sheet"), F.explode(kept).alias("c")).select("path", "sheet", "c.*")
    return tabular.sheet_modes(rows).select("sheet", "mode", F.col("header").cast("int").alias("header"), "reason")


@add("b03_titles", "SELECT p_partkey, [p_brand, p_brand || ' (2)', 'C', 'Size'] AS titles, [regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), 'col_row_number'] AS keys FROM part")
def _(s, d):
    rows = B.table(s, d, "part").select("p_partkey", "p_brand")

    @F.pandas_udf("struct<titles:array<string>,keys:array<string>>")
    def named(brand):
        import pandas as pd

        return pd.DataFrame({"titles": [tabular.titles([b, b, None, " Size "]) for b in brand], "keys": [tabular.keys([b, "row number"]) for b in brand]})

    return rows.withColumn("n", named("p_brand")).select("p_partkey", "n.titles", "n.keys")


@add("b11_manifest_after", "SELECT p_partkey AS identity, CASE WHEN p_partkey % 4 = 1 THEN 'new' ELSE 'old' END AS text_hash FROM part WHERE p_partkey % 4 <> 3")
def _(s, d):
    part = B.table(s, d, "part").select(F.col("p_partkey").alias("identity"))
    old = part.withColumn("text_hash", F.lit("old"))
    plan = part.where("identity % 4 in (1, 2)").select("identity", F.when(F.col("identity") % 4 == 1, "new").otherwise("kept").alias("text_hash"), F.when(F.col("identity") % 4 == 1, "re_embedded").otherwise("disappeared").alias("status"))
    return tabular.manifest_after(old, plan, part.where("identity % 4 = 3"))


_PLAIN = "trim(regexp_replace(replace(regexp_replace({}, '[-‐][ \\t]*\\n\\s*', '', 'g'), chr(173), ''), '\\s+', ' ', 'g'))"


@add("c28_located", f"""WITH f AS (SELECT item_id, {_PLAIN.format("text")} AS f FROM benchmark), d AS (SELECT doc_id, {_PLAIN.format("text")} AS t FROM documents),
p AS (SELECT item_id, doc_id, f, t, strpos(t, f) AS whole, strpos(t, f[:40]) AS a FROM f JOIN d ON f <> '' AND contains(t, f[:40])),
q AS (SELECT *, strpos(t[a + 40:], f[-40:]) AS z FROM p)
SELECT item_id, doc_id, CASE WHEN whole > 0 THEN 'exact' ELSE 'edges' END AS how, md5(CASE WHEN whole > 0 THEN f ELSE t[a:a + 40 + z + 38] END) AS said FROM q WHERE whole > 0 OR (length(f) > 80 AND z > 0)""")
def _(s, d):
    docs = B.table(s, d, "documents").select("doc_id", F.col("text").alias("t"))
    found = locating.located(docs, B.table(s, d, "benchmark").select("item_id", F.col("text").alias("f")))
    said = F.expr("substring(t, begin + 1, end - begin)")
    plain = F.trim(F.regexp_replace(F.replace(F.regexp_replace(said, r"[-‐][ \t]*\n\s*", ""), F.lit("\u00ad"), F.lit("")), r"\s+", " "))
    return found.where("how in ('exact', 'edges')").join(docs, "doc_id").select("item_id", "doc_id", "how", F.md5(plain).alias("said"))


@add("c13_sentences", r"""WITH p AS (SELECT item_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$') AS pieces FROM benchmark),
r AS (SELECT item_id, list_reduce(list_prepend('', pieces), lambda a, x: CASE WHEN length(regexp_replace(regexp_extract(a, '[^\x01]*$') || x, '^\s+|\s+$', '', 'g')) > 1 AND regexp_matches(x, '[.!?\n]$') THEN a || x || chr(1) ELSE a || x END) AS cut FROM p),
s AS (SELECT item_id, list_filter(list_transform(string_split(cut, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM r)
SELECT item_id, len(parts)::INT AS n, md5(array_to_string(parts, '|')) AS said FROM s""")
def _(s, d):
    @F.pandas_udf("array<string>")
    def cut(text):
        return text.map(chunking.sentences)

    return B.table(s, d, "benchmark").select("item_id", cut("text").alias("parts")).select("item_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("said"))


@add("x06_charset", "SELECT p_partkey, 'Größe ' || p_name AS text FROM part")
def _(s, d):
    rows = B.table(s, d, "part").select("p_partkey", F.concat(F.lit("Größe "), "p_name").alias("text"))
    coded = rows.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")).alias("data"), F.when(F.col("p_partkey") % 2 == 1, "iso-8859-1").alias("declared"))

    @F.pandas_udf("string")
    def text(data, declared):
        import pandas as pd

        return pd.Series([web.decoded(bytes(x), y) for x, y in zip(data, declared)])

    return coded.select("p_partkey", text("data", "declared").alias("text"))


@add("u01_decisions", "SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE 'unchanged' END AS status FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 'missing' FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 5 <> 0")
def _(s, d):
    files = B.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("size"), F.lit(0).alias("mtime"), F.sha2("p_name", 256).alias("content_hash"))
    old = files.where("cast(path as long) % 5 != 0").withColumn("recipe", F.lit(None).cast("string"))
    plan = sync.file_plan(files.where("cast(path as long) % 11 != 0"), old)
    return plan.select(F.col("path").cast("long").alias("path"), "status")


@add("v17_silhouette")
def _(s, d):
    vec = B.vectors(s, d)
    value = clustering.silhouette(vec, clustering.assign(vec, clustering.fit(vec, 4, 64)))
    return s.range(1).select(F.round(F.lit(value), 9).alias("silhouette"))


def _sheet(s, d):
    """Parts as a sheet now, and the manifest of an earlier run in which other rows stood."""
    part = B.table(s, d, "part").select(F.col("p_partkey").alias("row_number"), "p_partkey", "p_name", "p_brand", "p_size")
    m = tabular.Mapping({"p_partkey": "Number", "p_name": "Name", "p_brand": "Brand"}, ["p_name"], {"p_brand": "brand"}, "p_partkey")
    old = part.where("p_partkey % 5 != 0").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 1, "other").otherwise(F.col("p_name"))).withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 2, "other").otherwise(F.col("p_brand")))
    manifest = tabular.row_documents(old, m, "s", "t").select("id", "row_number", "row_key", "text_hash", "metadata_hash")
    return {**tabular.sheet_sync(part.where("p_partkey % 7 != 0"), m, manifest, "s", "t"), "now": tabular.row_documents(part, m, "s", "t")}


@add("b18_sheet_sync", "SELECT p_partkey AS row_number, CASE WHEN p_partkey % 7 = 0 THEN 'disappeared' WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 5 = 1 THEN 're_embedded' WHEN p_partkey % 5 = 2 THEN 'metadata_only' ELSE 'unchanged' END AS status FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 <> 0")
def _(s, d):
    return _sheet(s, d)["plan"].select(F.coalesce("row_number", "old_row").alias("row_number"), "status")


@add("b18_sheet_manifest", "SELECT p_partkey AS row_number, p_partkey % 7 <> 0 OR p_partkey % 5 <> 1 AS same_text, p_partkey % 7 <> 0 OR p_partkey % 5 <> 2 AS same_metadata FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 <> 0")
def _(s, d):
    found = _sheet(s, d)
    now = found["now"].select("row_number", F.col("text_hash").alias("t"), F.col("metadata_hash").alias("m"))
    return found["manifest"].join(now.hint("shuffle_merge"), "row_number").select("row_number", (F.col("text_hash") == F.col("t")).alias("same_text"), (F.col("metadata_hash") == F.col("m")).alias("same_metadata"))


@add("s35_extracted", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'plain' END AS extractor, CASE WHEN page_id % 3 = 1 THEN md5(html) END AS said, CASE WHEN page_id % 3 = 2 THEN 'no extractor' END AS problem FROM pages WHERE html IS NOT NULL AND length(regexp_replace(html, '<[^>]*>', '', 'g')) > 100")
def _(s, d):
    from ..sources import extract

    kind = F.element_at(F.array(F.lit("html"), F.lit("txt"), F.lit("xyz")), (F.col("page_id") % 3 + 1).cast("int"))
    pages = B.table(s, d, "pages").where("html is not null").where(F.length(F.regexp_replace("html", "<[^>]*>", "")) > 100)
    files = pages.select(F.concat_ws(".", "page_id", kind).alias("path"), F.encode("html", "UTF-8").alias("content"))
    said = F.when(F.col("extractor") == "plain", F.md5("text"))
    return extract.extracted(files).select(F.substring_index("path", ".", 1).cast("long").alias("page_id"), "extractor", said.alias("said"), "problem")


@add("v12_embedded", "SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 3 THEN [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, ' ', ''))]::DOUBLE[] END AS embedding FROM documents")
def _(s, d):
    from ..operators import embedding

    rows = B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 3, F.col("text")).alias("document"))
    return embedding.embedded(rows, lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts], batch=7).select("id", "embedding")


_FIRE = "CASE every WHEN 'hourly' THEN CASE WHEN date_trunc('hour', ts) + INTERVAL (m) MINUTE > ts THEN date_trunc('hour', ts) + INTERVAL (m) MINUTE ELSE date_trunc('hour', ts) + INTERVAL (m) MINUTE + INTERVAL 1 HOUR END WHEN 'daily' THEN CASE WHEN date_trunc('day', ts) + INTERVAL (h * 60 + m) MINUTE > ts THEN date_trunc('day', ts) + INTERVAL (h * 60 + m) MINUTE ELSE date_trunc('day', ts) + INTERVAL (h * 60 + m) MINUTE + INTERVAL 1 DAY END WHEN 'weekly' THEN CASE WHEN date_trunc('day', ts) + INTERVAL (h * 60 + m + ((w - isodow(ts) + 8) % 7) * 1440) MINUTE > ts THEN date_trunc('day', ts) + INTERVAL (h * 60 + m + ((w - isodow(ts) + 8) % 7) * 1440) MINUTE ELSE date_trunc('day', ts) + INTERVAL (h * 60 + m + ((w - isodow(ts) + 8) % 7 + 7) * 1440) MINUTE END END"
_PLANS = "SELECT event_id, ts, user_id, CASE event_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' END AS every, (event_id % 24)::INT AS h, (event_id % 60)::INT AS m, (event_id % 7)::INT AS w FROM events"


def _planned(s, d):
    kind = F.when(F.col("event_id") % 4 == 0, "hourly").when(F.col("event_id") % 4 == 1, "daily").when(F.col("event_id") % 4 == 2, "weekly")
    number = lambda n: (F.col("event_id") % n).cast("int")
    return B.table(s, d, "events").select("event_id", "ts", "user_id", kind.alias("every"), number(24).alias("hour"), number(60).alias("minute"), number(7).alias("weekday"))


@add("n10_next_fire", f"WITH p AS ({_PLANS}) SELECT event_id, epoch_us({_FIRE}) AS fires FROM p")
def _(s, d):
    at = V.next_fire(F.col("ts"), F.col("every"), F.col("hour"), F.col("minute"), F.col("weekday"))
    return _planned(s, d).select("event_id", F.unix_micros(at.cast("timestamp")).alias("fires"))


@add("t02_due", f"WITH p AS ({_PLANS}), n AS (SELECT TIMESTAMP '2024-01-16' AS now, TIMESTAMP '2024-01-02' AS started) SELECT event_id AS source, CASE WHEN event_id % 3 = 0 AND ts < started THEN 'launch' WHEN ({_FIRE}) <= now THEN 'schedule' WHEN event_id % 2 = 0 THEN 'watch' END AS reason FROM p, n WHERE user_id % 5 <> 0 AND ((event_id % 3 = 0 AND ts < started) OR coalesce(({_FIRE}) <= now, false) OR (event_id % 2 = 0 AND ts < now - INTERVAL 6 SECOND AND ts + INTERVAL 1 SECOND <= now - INTERVAL 5 SECOND))")
def _(s, d):
    sources = _planned(s, d).withColumnRenamed("event_id", "source").withColumnRenamed("ts", "last_run").withColumn("paused", F.col("user_id") % 5 == 0).withColumn("running", F.lit(False))
    sources = sources.withColumn("on_launch", F.col("source") % 3 == 0).withColumn("changed_at", F.when(F.col("source") % 2 == 0, F.col("last_run") + F.expr("interval 1 second")))
    return sync.due(sources, F.expr("timestamp_ntz '2024-01-16'"), F.expr("timestamp_ntz '2024-01-02'"))


# ---- readers of small texts, a file a row


def _of(kind, f):
    """A function of texts or bytes as an Arrow-batched column function."""

    @F.pandas_udf(kind)
    def run(values):
        return values.map(f)

    return run


@add("s15_delimited", "SELECT p_partkey, ';' AS sep, ['id', 'column2', 'name'] AS names, [p_partkey::VARCHAR, 'a;b \"' || p_brand || '\"', p_name] AS cells FROM part")
def _(s, d):
    quoted = F.concat(F.lit('"a;b ""'), "p_brand", F.lit('"""'))
    text = F.concat(F.lit("id;;name\r\n"), F.col("p_partkey").cast("string"), F.lit(";"), quoted, F.lit(";"), "p_name", F.lit("\r\n\r\n"), F.lit("1;2;3\n"))

    def read(t):
        names, rows = D.table(t)
        return {"sep": D.sniff(t), "names": names, "cells": rows[0]}

    @F.pandas_udf("struct<sep:string,names:array<string>,cells:array<string>>")
    def tables(texts):
        import pandas as pd

        return pd.DataFrame([read(t) for t in texts])

    return B.table(s, d, "part").withColumn("t", tables(text)).select("p_partkey", "t.sep", "t.names", "t.cells")


@add("s17_json_records", "SELECT p_partkey, 'a,b,c' AS names, p_name || '|' || p_size AS first FROM part")
def _(s, d):
    text = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("b"), F.col("p_size").alias("a")), F.struct(F.lit("x").alias("b"), F.lit(1).alias("a"))).alias("items")))
    text = F.replace(text, F.lit("]}"), F.lit(',{"c":null}]}'))

    def read(t):
        names, rows = D.json_records(t)
        return ",".join(names) + "\n" + rows[0]["b"] + "|" + rows[0]["a"]

    out = B.table(s, d, "part").withColumn("t", F.split(_of("string", read)(text), "\n"))
    return out.select("p_partkey", F.col("t")[0].alias("names"), F.col("t")[1].alias("first"))


@add("s19_encodings", "SELECT p_partkey, 'при ' || p_name AS text FROM part")
def _(s, d):
    text = F.concat(F.lit("при "), "p_name")
    coded = F.when(F.col("p_partkey") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("p_partkey") % 3 == 1, F.concat(F.unhex(F.lit("EFF0E820")), F.encode("p_name", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
    return B.table(s, d, "part").select("p_partkey", _of("string", lambda x: D.decode(bytes(x)))(coded).alias("text"))


@add("s36_plain_texts", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'ä' || p_name ELSE p_name END AS text FROM part")
def _(s, d):
    data = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.unhex(F.lit("00" * 6)), F.encode("p_name", "UTF-8"))).when(F.col("p_partkey") % 3 == 1, F.encode(F.concat(F.lit("ä"), "p_name"), "UTF-16")).otherwise(F.encode("p_name", "UTF-8"))
    return B.table(s, d, "part").select("p_partkey", _of("string", lambda x: D.plain_text(bytes(x)))(data).alias("text"))


@add("s40_sitemaps", "SELECT page_id, 'https://e.org/' || page_id || '?a=1&b=2' AS page, 'https://e.org/' || page_id || '.xml' AS map FROM pages")
def _(s, d):
    text = F.concat(F.lit("<x><url><priority>1</priority><loc> https://e.org/"), "page_id", F.lit("?a=1&amp;b=2 </loc></url><sitemap><loc>https://e.org/"), "page_id", F.lit(".xml</loc></sitemap></x>"))
    found = F.split(_of("string", lambda t: " ".join(x[0] for x in web.sitemap_urls(t)))(text), " ")
    return B.table(s, d, "pages").select("page_id", found[0].alias("page"), found[1].alias("map"))


@add("u18_robots", "WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, CASE WHEN starts_with(path, '/de/1') THEN true WHEN starts_with(path, '/de/') OR regexp_matches(path, '^/.*/2') THEN false ELSE true END AS allowed FROM p")
def _(s, d):
    rules = web.robots_rules("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /de/  # all\nAllow: /de/1\nDisallow: /*/2\nDisallow:\n")
    pages = B.table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return pages.select("page_id", _of("boolean", lambda p: web.robots_allows(rules, p))("path").alias("allowed"))


@add("c08_formats", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' WHEN 2 THEN 'code' WHEN 3 THEN 'code' END AS format FROM part")
def _(s, d):
    kinds = F.element_at(F.array(*map(F.lit, ("MD", "htm", "py", "Swift", "bin"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    formats = F.create_map(*[F.lit(x) for pair in sorted(chunking.FORMATS.items()) for x in pair])
    return B.table(s, d, "part").select("p_partkey", F.try_element_at(formats, F.lower(kinds)).alias("format"))


@add("b08_metadata_values", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN repeat('x', 2000) ELSE p_size::VARCHAR END AS value FROM part")
def _(s, d):
    # a long text, white space, and a whole number held as a double
    text = F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).when(F.col("p_partkey") % 4 == 1, F.repeat(F.lit("x"), F.lit(2100)))
    own = B.table(s, d, "part").select("p_partkey", text.alias("t"), F.col("p_size").cast("double").alias("n"))
    return own.select("p_partkey", F.when(F.col("p_partkey") % 4 < 2, tabular.metadata_value(F.col("t"))).otherwise(tabular.metadata_value(F.col("n"))).alias("value"))


@add("b16_merged_cells", "SELECT p_partkey AS row, 1 AS col, p_name AS value FROM part UNION ALL SELECT p_partkey, c, p_name FROM part, (VALUES (2), (3)) x(c) WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 2, p_brand FROM part WHERE p_partkey % 3 <> 0")
def _(s, d):
    part = B.table(s, d, "part").select(F.col("p_partkey").alias("row"), "p_name", "p_brand")
    cells = part.select("row", F.lit(1).alias("col"), F.col("p_name").alias("value")).unionByName(part.where("row % 3 != 0").select("row", F.lit(2).alias("col"), F.col("p_brand").alias("value")))
    merged = part.where("row % 3 = 0").select(F.col("row").alias("r0"), F.lit(1).alias("c0"), F.col("row").alias("r1"), F.lit(3).alias("c1"))
    return tabular.spread_merged(cells, merged)


@add("b07_unknown_placeholders", "SELECT p_partkey, 'x' || p_partkey AS unknown FROM part")
def _(s, d):
    template = F.concat(F.lit("{Name} of {x"), "p_partkey", F.lit("} and {Name}"))
    m = tabular.Mapping({"p_name": "Name"}, ["p_name"])
    find = _of("string", lambda t: ",".join(tabular.unknown_placeholders(tabular.Mapping(m.titles, m.text, template=t))))
    return B.table(s, d, "part").select("p_partkey", find(template).alias("unknown"))


@add("r01_pool", "SELECT DISTINCT least(greatest(p_size, 1), 100) AS n, greatest(least(greatest(p_size, 1), 100), 20, least(greatest(p_size, 1), 100) * 5) AS pool, least(greatest(p_size, 1), 100) AS plain FROM part")
def _(s, d):
    sizes = B.table(s, d, "part").select(F.least(F.greatest("p_size", F.lit(1)), F.lit(100)).alias("n")).distinct()
    return sizes.select("n", _of("int", lambda n: retrieval.pool_size(n, True))("n").alias("pool"), _of("int", lambda n: retrieval.pool_size(n, False))("n").alias("plain"))


@add("r10_text_gate", "SELECT item_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) <= 5 AS runs FROM benchmark")
def _(s, d):
    from . import search

    profile = search.SearchProfile(text_max_words=5)
    return B.table(s, d, "benchmark").select("item_id", _of("boolean", profile.text_runs)("text").alias("runs"))


@add("j15_deleted", "SELECT doc_id AS id, 'kept' AS what FROM documents WHERE doc_id NOT IN (SELECT c_custkey * 3 FROM customer) UNION ALL SELECT c_custkey * 3, 'missing' FROM customer WHERE c_custkey * 3 NOT IN (SELECT doc_id FROM documents)")
def _(s, d):
    rows = B.table(s, d, "documents").select(F.col("doc_id").alias("id"))
    asked = B.table(s, d, "customer").select((F.col("c_custkey") * 3).alias("id"))
    return C.deleted(rows, asked).withColumn("what", F.lit("kept")).unionByName(C.missing_ids(rows, asked).withColumn("what", F.lit("missing")))


@add("t06_running_totals", "SELECT event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(s, d):
    out = E.running_totals(B.table(s, d, "events"), "event_type", "value")
    return out.select("event_type", F.col("n").alias("events"), F.round("total", 4).alias("value"))


@add("v18_default_k", "SELECT n_nationkey, least(24, greatest(4, floor(sqrt(n_nationkey * 400) / 3 + 0.5)))::INT AS k FROM nation")
def _(s, d):
    return B.table(s, d, "nation").select("n_nationkey", _of("int", lambda n: clustering.default_k(n * 400))("n_nationkey").alias("k"))
