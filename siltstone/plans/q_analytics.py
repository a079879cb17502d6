"""Queries of inspection, evaluation, clustering and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import clustering, evaluation, inspection, knn
from ..sources import collections as C
from . import tables as B
from .q_retrieval import _knn_sql

Q: dict = {}
SQL: dict = {}


def add(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _docs(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source", "n_chars")


_L = f"WITH {B.LABELLED_SQL}"
_C = f"WITH {B.CHUNKS_SQL}"
_BUCKET = "CASE WHEN {0} >= 4000 THEN 4000 WHEN {0} >= 2000 THEN 2000 WHEN {0} >= 1000 THEN 1000 WHEN {0} >= 500 THEN 500 WHEN {0} >= 200 THEN 200 WHEN {0} >= 100 THEN 100 ELSE 0 END"


@add("a01_facets", f"{_L}, u AS (SELECT 'lang' AS field, lang AS value FROM labelled UNION ALL SELECT 'source', source FROM labelled UNION ALL SELECT 'quality', quality::VARCHAR FROM labelled), c AS (SELECT field, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS place FROM c) WHERE place <= 15")
def _(s, d):
    return inspection.facets(B.labelled(s, d), ["lang", "source", "quality"])


@add("a01_missing", f"{_L} SELECT 'lang' AS field, count(lang) AS present, count(*) - count(lang) AS missing FROM labelled UNION ALL SELECT 'quality', count(quality), count(*) - count(quality) FROM labelled")
def _(s, d):
    return inspection.missing(B.labelled(s, d), ["lang", "quality"])


@add("a02_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return inspection.months(B.table(s, d, "orders"), "o_orderdate")


@add("a03_length_histogram", f"SELECT low, coalesce(n, 0) AS n FROM (VALUES (0), (100), (200), (500), (1000), (2000), (4000)) b(low) LEFT JOIN (SELECT {_BUCKET.format('length(text)')} AS low, count(*) AS n FROM documents GROUP BY 1) USING (low)")
def _(s, d):
    return inspection.length_histogram(_docs(s, d))


@add("a03_upper_median", "SELECT lang, list_sort(list(length(text)))[count(*) // 2 + 1]::INT AS median FROM documents GROUP BY lang")
def _(s, d):
    return inspection.upper_median(_docs(s, d).withColumn("n", F.length("document")), "n", ["lang"])


@add("a04_duplicates", "SELECT sha256(trim(text)) AS text_hash, count(*) AS n, list_sort(list(doc_id)) AS ids, list_sort(list_distinct(list(source)))[1:3] AS files FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return inspection.duplicates(_docs(s, d), files="source")


@add("a04_members", "SELECT id, text_hash, n FROM (SELECT doc_id AS id, sha256(trim(text)) AS text_hash, count(*) OVER (PARTITION BY sha256(trim(text))) AS n FROM documents WHERE trim(text) <> '') WHERE n > 1")
def _(s, d):
    return inspection.duplicate_members(_docs(s, d))


@add("a05_chunk_gaps", f"{_C}, k AS (SELECT file, chunk_index, lag(chunk_index, 1, -1) OVER (PARTITION BY file ORDER BY chunk_index) AS before FROM chunks WHERE chunk_index % 7 <> 2 AND chunk_index % 5 <> 0) SELECT file, unnest(generate_series(before + 1, chunk_index - 1)) AS missing FROM k WHERE chunk_index - before > 1")
def _(s, d):
    return inspection.chunk_gaps(B.chunks(s, d).where("chunk_index % 7 != 2 AND chunk_index % 5 != 0"))


@add("a06_row_problems", f"{_L} SELECT id, 'no_metadata' AS category FROM labelled WHERE quality IS NULL AND toxic IS NULL UNION ALL SELECT id, 'empty' FROM labelled WHERE trim(document) = '' UNION ALL SELECT id, 'wordless' FROM labelled WHERE trim(document) <> '' AND NOT regexp_matches(document, '[\\p{{L}}\\p{{N}}]')")
def _(s, d):
    return inspection.row_problems(B.labelled(s, d), F.col("document"), ["quality", "toxic"])


@add("a07_superseded", "SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id * 1000 AS parent_id FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 WHERE c.role <> p.role")
def _(s, d):
    rows = B.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000).alias("parent_id"), F.col("role").alias("run"))
    return inspection.superseded(rows)


@add("a09_findings_diff", f"{_L}, b AS (SELECT lang AS category, count(*) AS before FROM labelled WHERE quality = 1 GROUP BY 1), a AS (SELECT lang AS category, count(*) AS after FROM labelled WHERE toxic = 1 GROUP BY 1) SELECT category, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (category)")
def _(s, d):
    rows = B.labelled(s, d).withColumnRenamed("lang", "category")
    return inspection.findings_diff(rows.where("quality = 1"), rows.where("toxic = 1"))


@add("a10_mentions", f"{_C}, m AS (SELECT * FROM chunks WHERE contains(document, 'tion') OR contains(document, 'Tion') OR contains(document, 'TION')), f AS (SELECT file, count(*) AS hits FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk_index, id) AS k FROM m) SELECT f.file, any_value(hits) AS hits, (SELECT count(*) FROM f g WHERE g.hits > any_value(f.hits) OR (g.hits = any_value(f.hits) AND g.file <= f.file)) AS place, list(id ORDER BY k) AS samples FROM f JOIN n ON f.file = n.file AND k <= 3 GROUP BY f.file")
def _(s, d):
    return inspection.mentions(B.chunks(s, d), "tion")


# evaluation: hits are the neighbours of vectors whose id is divisible by 100, relevant ones have the query's label
_GRADED = f"""{_knn_sql(k=20)}, truth AS (SELECT q.vec_id AS query_id, v.vec_id AS id, CASE WHEN v.vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS gain FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.label = q.label AND v.vec_id % 11 = q.vec_id % 11),
cells AS (SELECT DISTINCT query_id, v AS variant FROM hits CROSS JOIN (VALUES ('near'), ('far')) x(v)),
vh AS (SELECT query_id, 'near' AS variant, id, position FROM hits UNION ALL SELECT query_id, 'far', id, 21 - position FROM hits),
graded AS (SELECT vh.*, gain FROM vh LEFT JOIN truth USING (query_id, id))"""


def _evaluated(s, d):
    vec = B.vectors(s, d).select("id", "label", "embedding")
    queries = vec.where("id % 100 = 0")
    hits = knn.nearest(vec, queries, 20).select("query_id", "id", "position")
    both = hits.withColumn("variant", F.lit("near")).unionByName(hits.withColumn("variant", F.lit("far")).withColumn("position", 21 - F.col("position")))
    q = queries.select(F.col("id").alias("query_id"), "label", (F.col("id") % 11).alias("part"))
    truth = q.join(vec.select("id", "label", (F.col("id") % 11).alias("part")), ["label", "part"]).select("query_id", "id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5).alias("gain"))
    return evaluation.graded(both, truth), truth, both.select("query_id", "variant").distinct()


@add("a11_metrics", f"""WITH {_GRADED}, ks AS (SELECT unnest([1, 5, 10]) AS k), base AS (SELECT c.query_id, c.variant, k FROM cells c, ks WHERE query_id IN (SELECT query_id FROM truth)),
known AS (SELECT query_id, count(*) AS known FROM truth GROUP BY 1),
f AS (SELECT b.query_id, b.variant, b.k, count(g.gain) AS found, coalesce(sum(g.gain / log2(g.position + 1)), 0) AS dcg, coalesce(list(g.gain) FILTER (g.gain IS NOT NULL), []) AS gains FROM base b LEFT JOIN graded g ON g.query_id = b.query_id AND g.variant = b.variant AND g.position <= b.k AND g.gain > 0 GROUP BY ALL),
m AS (SELECT b.query_id, b.variant, b.k, coalesce(list(t.gain) FILTER (t.gain IS NOT NULL), []) AS lost FROM base b JOIN truth t ON t.query_id = b.query_id AND NOT EXISTS (SELECT 1 FROM graded g WHERE g.query_id = b.query_id AND g.variant = b.variant AND g.position <= b.k AND g.id = t.id) GROUP BY ALL),
i AS (SELECT f.*, known, list_reverse_sort(list_concat(gains, coalesce(lost, [])))[1:f.k] AS ideal FROM f LEFT JOIN m USING (query_id, variant, k) JOIN known USING (query_id)),
x AS (SELECT *, (SELECT sum(g / log2(n + 1)) FROM (SELECT unnest(ideal) AS g, generate_subscripts(ideal, 1) AS n)) AS idcg FROM i),
r AS (SELECT c.query_id, c.variant, coalesce(1 / (SELECT min(position) FROM graded g WHERE g.query_id = c.query_id AND g.variant = c.variant AND gain > 0), 0) AS rr FROM cells c WHERE query_id IN (SELECT query_id FROM truth))
SELECT variant, 'hit_rate' AS metric, k, round(avg((found > 0)::INT), 6) AS value FROM x GROUP BY ALL UNION ALL SELECT variant, 'recall', k, round(avg(least(1.0, found / known)), 6) FROM x GROUP BY ALL
UNION ALL SELECT variant, 'ndcg', k, round(avg(CASE WHEN idcg > 0 THEN least(1.0, dcg / idcg) ELSE 0 END), 6) FROM x GROUP BY ALL UNION ALL SELECT variant, 'mrr', 0, round(avg(rr), 6) FROM r GROUP BY ALL""")
def _(s, d):
    hits, truth, cells = _evaluated(s, d)
    return evaluation.metrics(hits, truth, cells).withColumn("value", F.round("value", 6))


@add("a15_latency", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(s, d):
    return evaluation.latency(B.table(s, d, "events"), "value", ["event_type"])


@add("a16_coverage", f"WITH {_GRADED} SELECT variant, count(*) AS hits, count(gain) AS graded, count(*) FILTER (gain >= 1) AS relevant, count(*) FILTER (gain > 0 AND gain < 1) AS partial, count(*) FILTER (gain = 0) AS irrelevant FROM graded GROUP BY 1")
def _(s, d):
    return evaluation.coverage(_evaluated(s, d)[0])


@add("a17_best_cells", "WITH t AS (SELECT event_type, user_id % 10 AS g, round(avg(value), 6) AS v FROM events GROUP BY ALL) SELECT *, coalesce(v = max(v) OVER (PARTITION BY g) AND min(v) OVER (PARTITION BY g) <> max(v) OVER (PARTITION BY g) AND count(v) OVER (PARTITION BY g) >= 2, false) AS best FROM t")
def _(s, d):
    t = B.table(s, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("g")).agg(F.round(F.avg("value"), 6).alias("v"))
    return evaluation.best_cells(t, ["g"], "v")


_OUT = f"WITH {_GRADED}, p AS (SELECT c.query_id, c.variant, min(g.position) AS p FROM cells c LEFT JOIN graded g ON g.query_id = c.query_id AND g.variant = c.variant AND g.gain > 0 GROUP BY ALL), o AS (SELECT *, CASE WHEN query_id NOT IN (SELECT query_id FROM truth) THEN 'unmarked' WHEN p IS NULL THEN 'missed' ELSE 'found' END AS outcome FROM p), r AS (SELECT query_id, variant, outcome, CASE outcome WHEN 'missed' THEN 21 WHEN 'found' THEN p END::INT AS rank FROM o)"


@add("a18_outcomes", f"{_OUT} SELECT * FROM r")
def _(s, d):
    hits, truth, cells = _evaluated(s, d)
    return evaluation.outcomes(hits, cells, truth, 20)


@add("a19_most_divergent", f"{_OUT} SELECT query_id, md5(text) AS text, max(rank) - min(rank) AS spread FROM r JOIN documents ON doc_id = query_id WHERE rank IS NOT NULL GROUP BY query_id, text HAVING max(rank) > min(rank) ORDER BY spread DESC, documents.text DESC LIMIT 10")
def _(s, d):
    hits, truth, cells = _evaluated(s, d)
    texts = B.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return evaluation.most_divergent(evaluation.outcomes(hits, cells, truth, 20), texts).withColumn("text", F.md5(F.col("text").cast("binary")))


@add("a21_deltas", "WITH b AS (SELECT event_type AS variant, 'mean' AS metric, 0 AS k, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 0 GROUP BY ALL), a AS (SELECT event_type AS variant, 'mean' AS metric, 0 AS k, round(avg(value), 6) AS v FROM events WHERE user_id % 2 = 1 AND event_type <> 'error' GROUP BY ALL) SELECT variant, metric, k, b.v AS before, a.v AS after, round(a.v - b.v, 6) AS delta, CASE WHEN abs(a.v - b.v) >= 0.005 THEN a.v > b.v END AS improved FROM b FULL JOIN a USING (variant, metric, k)")
def _(s, d):
    e = B.table(s, d, "events")

    def run(df):
        return df.groupBy(F.col("event_type").alias("variant")).agg(F.round(F.avg("value"), 6).alias("value")).select("variant", F.lit("mean").alias("metric"), F.lit(0).alias("k"), "value")

    return evaluation.deltas(run(e.where("user_id % 2 = 0")), run(e.where("user_id % 2 = 1 AND event_type != 'error'"))).withColumn("delta", F.round("delta", 6))


@add("a22_run_cost", "SELECT count(DISTINCT text) AS texts, round(count(DISTINCT text) * 3 * 0.05, 6) AS seconds FROM benchmark")
def _(s, d):
    return B.table(s, d, "benchmark").agg(F.count_distinct("text").alias("texts")).withColumn("seconds", F.round(F.col("texts") * 3 * F.lit(0.05), 6))


@add("a24_running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    from ..streaming.events import running_totals

    return running_totals(B.table(s, d, "events"), "event_type", "value").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@add("a25_benchmark_best", "SELECT arg_max(event_type, n) AS best, max(n) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(s, d):
    return B.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).agg(F.max_by("event_type", "n").alias("best"), F.max("n").alias("n"))


@add("a26_manifest_stats", f"{_C} SELECT count(*) AS chunks, count(DISTINCT file) AS files, count(DISTINCT source) AS collections FROM chunks")
def _(s, d):
    return B.chunks(s, d).agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"), F.count_distinct("source").alias("collections"))


@add("a27_folder_levels", "WITH p AS (SELECT r_name || '/' || n_name || '/' || (c_custkey % 5) || '/' || c_custkey || '.txt' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT unnest([0, 1, 2]) AS level, unnest(string_split(path, '/')[1:3]) AS folder FROM p) SELECT level, count(DISTINCT folder) AS folders, count(*) AS files, min(folder) AS first FROM x GROUP BY level")
def _(s, d):
    c = B.table(s, d, "customer").join(B.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(B.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return inspection.folder_levels(c.select(F.concat_ws("/", "r_name", "n_name", (F.col("c_custkey") % 5).cast("string"), F.concat(F.col("c_custkey").cast("string"), F.lit(".txt"))).alias("path")))


_KIND = "CASE WHEN regexp_matches(trim(v), '^[+-]?\\d+$') THEN 'integer' WHEN regexp_matches(trim(v), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'number' WHEN trim(v) IN ('true', 'false') THEN 'boolean' ELSE 'string' END"


@add("a28_schema", f"{_L}, u AS (SELECT 'lang' AS field, lang AS v FROM labelled UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM labelled UNION ALL SELECT 'quality', quality::VARCHAR FROM labelled), k AS (SELECT field, {_KIND} AS kind FROM u WHERE v IS NOT NULL) SELECT field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'string' END AS type, count(*) = (SELECT count(*) FROM labelled) AS required, count(*) AS present FROM k GROUP BY field")
def _(s, d):
    return inspection.inferred_schema(B.labelled(s, d), ["lang", "n_chars", "quality"])


@add("a29_keywords", "WITH w AS (SELECT item_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'that'))) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'that')), 1) AS spot FROM benchmark), c AS (SELECT id, word, count(*) AS n, min(spot) AS first FROM w GROUP BY ALL) SELECT * FROM (SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 8")
def _(s, d):
    return inspection.keywords(B.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("document")), ["the", "and", "that"])


@add("a30_violations", f"{_L} SELECT id, 'quality' AS field, 'missing_required' AS violation FROM labelled WHERE quality IS NULL UNION ALL SELECT id, 'source', 'wrong_type' FROM labelled UNION ALL SELECT id, 'toxic', 'unexpected_field' FROM labelled WHERE toxic IS NOT NULL")
def _(s, d):
    return inspection.violations(B.labelled(s, d), [("quality", "integer", True), ("source", "integer", False), ("n_chars", "number", True)], ["toxic"], allow_extra=False)


@add("a33_distinct", "SELECT DISTINCT lower(lang) AS lang, source FROM documents")
def _(s, d):
    return B.table(s, d, "documents").select(F.lower("lang").alias("lang"), "source").distinct()


@add("a37_field_summary", f"{_L}, u AS (SELECT 'lang' AS field, lang AS v FROM labelled UNION ALL SELECT 'n_chars', n_chars::VARCHAR FROM labelled), k AS (SELECT field, v, {_KIND} AS kind FROM u WHERE v IS NOT NULL AND v <> '') SELECT field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS type, list_sort(list_distinct(list(v)))[1:5] AS examples FROM k GROUP BY field")
def _(s, d):
    return inspection.field_summary(B.labelled(s, d), ["lang", "n_chars"])


@add("a38_preview_stats", "SELECT count(*) AS n, (sum(length(text)) // count(*))::BIGINT AS mean, min(length(text))::INT AS least, max(length(text))::INT AS most, count(*) FILTER (turn = 0) AS parents FROM conversations")
def _(s, d):
    n = F.length("text")
    return B.table(s, d, "conversations").agg(F.count("*").alias("n"), F.expr("sum(length(text)) div count(*)").alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(F.col("turn") == 0).alias("parents"))


@add("a40_by_model", "SELECT label % 3 AS model, count(DISTINCT label) AS collections, count(*) AS documents FROM embeddings GROUP BY 1")
def _(s, d):
    return B.vectors(s, d).groupBy((F.col("label") % 3).alias("model")).agg(F.count_distinct("label").alias("collections"), F.count("*").alias("documents"))


@add("a41_trash_restore", f"{_L} SELECT source AS collection, count(*) FILTER (quality IS NOT NULL) AS restorable, count(*) FILTER (quality IS NULL) AS skipped FROM labelled GROUP BY 1")
def _(s, d):
    from ..sources.transfer import restore_plan

    return restore_plan(B.labelled(s, d).withColumn("collection", F.col("source")), "document", "quality")


@add("j04_graded_documents", f"WITH {_GRADED} SELECT query_id, variant, position, id, gain FROM graded")
def _(s, d):
    return _evaluated(s, d)[0].select("query_id", "variant", "position", "id", "gain")


@add("j05_fragments", "WITH f AS (SELECT item_id, strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS t FROM benchmark), h AS (SELECT doc_id, strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS t FROM documents) SELECT item_id, doc_id FROM h JOIN f ON contains(h.t, f.t)")
def _(s, d):
    f = B.table(s, d, "benchmark").select("item_id", T.folded(F.col("text")).alias("f"))
    h = B.table(s, d, "documents").select("doc_id", T.folded(F.col("text")).alias("t"))
    return evaluation.containing(h, f)


@add("j06_runs", "WITH a AS (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 0), b AS (SELECT DISTINCT event_type FROM events WHERE user_id % 3 = 0 AND event_type <> 'view') SELECT coalesce(a.event_type, b.event_type) AS variant, CASE WHEN b.event_type IS NULL THEN 'before' WHEN a.event_type IS NULL THEN 'after' ELSE 'both' END AS side FROM a FULL JOIN b ON a.event_type = b.event_type")
def _(s, d):
    e = B.table(s, d, "events")
    named = e.select(F.col("event_type").alias("variant"), "user_id")
    return evaluation.variants(named.where("user_id % 2 = 0"), named.where("user_id % 3 = 0 AND variant != 'view'"))


@add("j16_as_of", "SELECT e.event_id, max(p.event_id) AS page FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'view' AND p.event_id <= e.event_id GROUP BY 1")
def _(s, d):
    # the last view at or before each event: one window instead of a theta join
    e = B.table(s, d, "events")
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return e.select("event_id", last.alias("page")).where("page is not null")


@add("v09_strided_sample")
def _(s, d):
    return clustering.strided(B.vectors(s, d), 50).select("id")


@add("v16_kmeans")
def _(s, d):
    vec = B.vectors(s, d)
    return clustering.assign(vec, clustering.fit(vec, 10, 64)).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 6).alias("inertia"))


@add("v15_assign", "WITH c AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE vec_id < 8), p AS (SELECT v.vec_id AS id, c.k, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS dist FROM embeddings v CROSS JOIN c) SELECT id, arg_min(k, dist * 1000 + k * 1e-12)::INT AS cluster, round(min(dist), 6) AS distance FROM p GROUP BY id")
def _(s, d):
    import numpy as np

    first = B.vectors(s, d).where("id < 8").orderBy("id").select("embedding").collect()
    return clustering.assign(B.vectors(s, d), clustering.unit(np.array([r[0] for r in first], float))).withColumn("distance", F.round(F.abs("distance"), 6))


@add("v19_outliers", "WITH a AS (SELECT label::INT AS cluster, n_chars::DOUBLE AS distance FROM embeddings JOIN documents ON vec_id = doc_id), m AS (SELECT cluster, list_sort(list(distance))[count(*) // 2 + 1] AS median FROM a GROUP BY 1), x AS (SELECT cluster, list_sort(list(abs(distance - median)))[count(*) // 2 + 1] AS mad FROM a JOIN m USING (cluster) GROUP BY 1) SELECT cluster, median, CASE WHEN mad > 0 THEN median + 2 * mad END AS threshold FROM m JOIN x USING (cluster)")
def _(s, d):
    a = B.vectors(s, d).join(B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id").select("id", F.col("label").cast("int").alias("cluster"), F.col("n_chars").cast("double").alias("distance"))
    return clustering.outlier_threshold(a)


@add("v20_topics")
def _(s, d):
    vec = B.vectors(s, d)
    return clustering.topics(vec, clustering.fit(vec, 8, 64)).select("cluster", "size", "outliers", "examples")


@add("w05_contiguous_runs", f"{_C}, g AS (SELECT file, chunk_index, chunk_index - row_number() OVER (PARTITION BY file ORDER BY chunk_index) AS run FROM chunks WHERE chunk_index % 6 <> 4) SELECT file, min(chunk_index) AS first, count(*) AS n FROM g GROUP BY file, run")
def _(s, d):
    c = B.chunks(s, d).where("chunk_index % 6 != 4")
    run = F.col("chunk_index") - F.row_number().over(W.partitionBy("file").orderBy("chunk_index"))
    return c.withColumn("run", run).groupBy("file", "run").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n")).drop("run")


@add("w08_examples", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings) WHERE n <= 3")
def _(s, d):
    n = F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "id"))
    return B.vectors(s, d).withColumn("n", n).where("n <= 3").select("label", F.col("id").alias("vec_id"))


@add("o02_file_order", f"{_C}, c AS (SELECT id, file, CASE WHEN id % 9 <> 4 THEN chunk_index // 2 END AS chunk_index FROM chunks) SELECT id, file, chunk_index, row_number() OVER (PARTITION BY file ORDER BY chunk_index NULLS LAST, id) - 1 AS place FROM c")
def _(s, d):
    chunks = B.chunks(s, d).select("id", "file", F.when(F.col("id") % 9 != 4, F.floor(F.col("chunk_index") / 2)).alias("chunk_index"))
    return C.in_file_order(chunks)


@add("o05_natural_order", "SELECT source, row_number() OVER (ORDER BY regexp_extract(source, '\\d+')::INT) AS place FROM (SELECT DISTINCT source FROM documents)")
def _(s, d):
    names = B.table(s, d, "documents").select("source").distinct()
    return names.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(V.natural_key(F.col("source")))))


@add("o07_union", "SELECT doc_id AS id FROM documents UNION ALL SELECT vec_id FROM embeddings")
def _(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id")).unionByName(B.vectors(s, d).select("id"))


@add("o08_union_distinct", "SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings")
def _(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id")).unionByName(B.vectors(s, d).select("id")).distinct()


@add("o09_intersect", "SELECT doc_id AS id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def _(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id")).intersect(B.vectors(s, d).select("id"))


@add("o10_except", "SELECT doc_id AS id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def _(s, d):
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id")).subtract(B.vectors(s, d).select("id"))
