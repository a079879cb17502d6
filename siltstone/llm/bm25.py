"""Exact top-k search by BM25 over sharded inverted indexes with block-max pruning.

Each task turns its documents into shards: posting lists by term, document
lengths, ids, and for each list and block of ``RANGE`` documents the largest
count and the shortest document, from which follows the most that the term can
add to a score there. Document frequencies, the number of documents and their
mean length are taken over all shards, so scores are those of one index.

A shard is searched in document order. The pivot is the next block whose summed
maxima over the query's lists reach the k-th best score so far: all lists skip
to it, and only its postings are scored. Instead of one posting, a growing
number of blocks from the pivot on is judged and scored at once, since cursors
moved posting by posting do not vectorise: the queries go through the blocks
together, each by its own pivots, and those that stop at a block are scored
there by one product with the lists that are common in the shard. Documents
near the k-th best are scored again, exactly. In a shard whose rows share ids a
query goes alone; there the blocks with the highest sums come before all others,
for a score to beat. What the shards return is merged by score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, read_table, slices, text_bytes, written
from .ngram_join import SLICE, word_hashes

K1, B = 1.2, 0.75
K = 10
RANGE = 64  # documents of a block, under one bound
SHARD_WORDS = 3_000_000  # words at which a shard is closed
QUERY_TERMS = 1_000_000  # terms of the queries held by the driver and broadcast at once, about
FIRST = 4  # blocks scored before the others
COMMON = 16  # a list with one in so many documents of a shard is common
CELLS = 2_000_000  # scores of queries by documents held at once
#: Each shard is a file and comes to its task alone, as a file's rows are written and read at once.
A_FILE_EACH = {"spark_sql_files_maxRecordsPerFile": "1"}
ALONE = {"spark_sql_execution_arrow_maxRecordsPerBatch": "1"}
#: Texts come to Python so many bytes at once.
FEW_BYTES = {"spark_sql_execution_arrow_maxBytesPerBatch": "16777216"}

#: What a shard is stored as.
ARRAYS = ["ids", "known", "lengths", "terms", "start", "doc", "tf", "block", "block_from", "block_tf", "block_length", "list_from"]

#: Words are stretches of ASCII letters and digits and of all bytes beyond ASCII.
SOLID = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def _postings(hashes: list[np.ndarray], lengths: np.ndarray):
    """Terms in order, where each one's postings start, and their documents and counts."""
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([new, [len(h)]]))
    h, doc = h[new], doc[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else new
    return h[first], np.concatenate([first, [len(h)]]).astype(np.uint32), doc, tf.astype(np.uint32)


def _blocks(start: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray):
    """Of each list's blocks the number, first posting, largest count and shortest document, and where each list's blocks begin."""
    if not len(doc):
        none = np.zeros(0, np.uint32)
        return none, none, none, none, np.zeros(len(start), np.uint32)
    of = doc // RANGE
    new = np.concatenate([[True], of[1:] != of[:-1]])
    new[start[:-1]] = True
    cut = np.flatnonzero(new)
    least = np.minimum.reduceat(lengths[doc], cut)
    return tuple(x.astype(np.uint32) for x in (of[cut], cut, np.maximum.reduceat(tf, cut), least, np.searchsorted(cut, start)))


def narrowed(a: np.ndarray) -> np.ndarray:
    """Counts and places in as few bytes each as the largest of them takes."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def widths(data, n: int) -> np.ndarray:
    """The ``n`` numbers of ``narrowed``."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per shard, written to shared storage: documents and words in it, and its arrays."""

    def run(batches):
        import pyarrow as pa

        ids, hashes, lengths, words = [], [], [], 0

        def close():
            n = np.concatenate(lengths)
            terms, start, doc, tf = _postings(hashes, n)
            all_ids = pa.chunked_array(ids).combine_chunks()
            known = np.asarray(all_ids.is_valid())
            *blocks, list_from = _blocks(start, doc, tf, n.astype(np.uint32))
            arrays = [np.asarray(all_ids.fill_null(0)), known, narrowed(n), terms, start, narrowed(doc), narrowed(tf), *map(narrowed, blocks), list_from]
            return pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["docs", "words", *ARRAYS])

        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for first, last in slices(bounds, SLICE):
                h, at = word_hashes(data[bounds[first]: bounds[last]], bounds[first: last + 1] - bounds[first], SOLID)
                ids.append(b.column(0).slice(first, last - first))
                hashes.append(h)
                lengths.append(np.diff(at))
                words += len(h)
                if words > SHARD_WORDS:
                    yield close()
                    ids, hashes, lengths, words = [], [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "docs long, words long, " + ", ".join(f"{name} binary" for name in ARRAYS)
    return written(rows.mapInArrow(run, schema), "bm25", **A_FILE_EACH, **FEW_BYTES)


def term_counts(docs: DataFrame) -> DataFrame:
    """(query_id, term, tf) of every document of ``docs`` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for first, last in slices(bounds, SLICE):
                h, at = word_hashes(data[bounds[first]: bounds[last]], bounds[first: last + 1] - bounds[first], SOLID)
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    term, tf = np.unique(h[lo:hi], return_counts=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first + i, 1).take(pa.array(np.zeros(len(term), np.int64))), pa.array(term.view(np.int64)), pa.array(tf)], ["query_id", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "query_id long, term long, tf long").groupBy("query_id", "term").agg(F.max("tf").alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for terms, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.diff(np.frombuffer(start, np.uint32)).astype(np.int64)
                h = np.frombuffer(terms, np.int64)
                for lo in range(0, len(h), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo: lo + 65_536]), pa.array(n[lo: lo + 65_536])], ["term", "df"])

    return index.select("terms", "start").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def idf(df, n):
    return F.log1p((n - df + 0.5) / (df + 0.5))


def query_terms(counts: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(query_id, term, idf): every distinct term of each query that a document has."""
    return counts.join(frequencies, "term").select("query_id", "term", idf(F.col("df"), F.lit(n)).alias("idf"))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Shard:
    """One shard's lists, weighed for the terms that any query asks for (``terms`` in order, ``idf``)."""

    def __init__(self, row: dict, mean: float, terms: np.ndarray, idf: np.ndarray):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.start, self.list_from = (np.frombuffer(row[name], np.uint32).astype(np.int64) for name in ("start", "list_from"))
        weight = np.zeros(len(self.terms))
        if len(terms):
            at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
            weight = np.where(terms[at] == self.terms, idf[at], 0.0)
        postings, blocks = int(self.start[-1]), int(self.list_from[-1])
        norm = lambda length: K1 * (1 - B + B * length / mean)

        def parts(tf, norms, of):  # in place, as there are many
            tf = tf.astype(float)
            norms += tf
            tf *= K1 + 1
            tf /= norms
            tf *= np.repeat(weight, np.diff(of))
            return tf

        # what a term adds to a score: at a posting, and at most in a block
        self.doc = doc = widths(row["doc"], postings)
        self.part = parts(widths(row["tf"], postings), norm(widths(row["lengths"], len(self.ids)))[doc], self.start)
        self.most = parts(widths(row["block_tf"], blocks), norm(widths(row["block_length"], blocks)), self.list_from)
        self.block = widths(row["block"], blocks).astype(np.int64)
        self.block_from = np.append(widths(row["block_from"], blocks), postings).astype(np.int64)
        self.blocks = -(-len(self.ids) // RANGE)
        held = self.ids[self.known]
        self.repeats = len(np.unique(held)) < len(held)
        # the common lists as a table, their block maxima as another, and each document's postings in order of terms
        n = np.diff(self.start)
        lists = np.flatnonzero((n * COMMON >= len(self.ids)) & (weight > 0))
        self.column = np.full(len(self.terms), -1)
        self.column[lists] = np.arange(len(lists))
        self.dense, self.highest = np.zeros((len(lists), len(self.ids)), np.float32), np.zeros((len(lists), self.blocks), np.float32)
        for i, t in enumerate(lists.tolist()):
            self.dense[i, self.doc[self.start[t]: self.start[t + 1]]] = self.part[self.start[t]: self.start[t + 1]]
            self.highest[i, self.block[self.list_from[t]: self.list_from[t + 1]]] = self.most[self.list_from[t]: self.list_from[t + 1]]
        by = np.argsort(doc, kind="stable")
        self.own_term, self.own_at = np.repeat(np.arange(len(self.terms), dtype=np.int32), n)[by], by.astype(np.uint32)
        self.own_from = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))])

    def search_many(self, queries: list[tuple[int, np.ndarray]], beaten: list[float], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` of several queries, which go through the blocks together; scores below ``beaten`` may be left out.

        At each block the queries whose maxima there reach their k-th best are
        scored by one product of the common lists; the short lists of a query
        are summed before. Products round, so documents within the rounding of
        the k-th best are scored again, exactly.
        """
        if self.repeats or not len(self.terms):
            return [self.search(query, terms, k) for query, terms in queries]
        every = max(1, CELLS // len(self.ids))
        return [x for lo in range(0, len(queries), every) for x in self._together(queries[lo: lo + every], np.array(beaten[lo: lo + every], np.float32), k)]

    def _together(self, queries, beaten, k):
        docs, slack = len(self.ids), 1 - (len(self.dense) + 64) * 2.0 ** -22
        asked, of = np.concatenate([t for _, t in queries]), np.repeat(np.arange(len(queries)), [len(t) for _, t in queries])
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        own = self.terms[at] == asked
        at, of = at[own], of[own]
        column = self.column[at]
        wants = np.zeros((len(queries), len(self.dense)), np.float32)
        wants[of[column >= 0], column[column >= 0]] = 1
        cut = np.searchsorted(of, np.arange(len(queries) + 1))
        rest = np.zeros((len(queries), docs), np.float32)
        for i in range(len(queries)):
            lists = at[cut[i]: cut[i + 1]]
            lists = lists[self.column[lists] < 0]
            if len(lists):
                spans = list(zip(self.start[lists].tolist(), self.start[lists + 1].tolist()))
                rest[i] = np.bincount(np.concatenate([self.doc[lo:hi] for lo, hi in spans]), np.concatenate([self.part[lo:hi] for lo, hi in spans]), docs)
        bound = (wants @ self.highest + np.maximum.reduceat(rest, np.arange(0, docs, RANGE), axis=1)) / np.float32(slack)

        names = np.array([q for q, _ in queries])
        best, least, met = np.zeros((len(queries), k), np.float32), beaten * np.float32(slack), []
        for block in range(self.blocks):
            q = np.flatnonzero((bound[:, block] >= least) & (bound[:, block] > 0))
            if not len(q):
                continue
            lo, hi = block * RANGE, min(docs, (block + 1) * RANGE)
            total = wants[q] @ self.dense[:, lo:hi] + rest[q, lo:hi]
            total[(self.ids[lo:hi] == names[q, None]) | ~self.known[lo:hi]] = 0
            best[q] = np.partition(np.concatenate([best[q], total], 1), hi - lo, axis=1)[:, -k:]
            least[q] = np.maximum(least[q], best[q].min(1) * np.float32(slack))
            row, place = np.nonzero((total >= least[q, None]) & (total > 0))
            met.append((q[row], place + lo, total[row, place]))
        if not met:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        q, doc, total = map(np.concatenate, zip(*met))
        kept = total >= least[q]
        q, doc = q[kept], doc[kept]
        order = np.argsort(q, kind="stable")
        doc, ends = doc[order], np.searchsorted(q[order], np.arange(len(queries) + 1))
        asks, out = np.zeros(len(self.terms), bool), []
        for i in range(len(queries)):
            found, lists = doc[ends[i]: ends[i + 1]], at[cut[i]: cut[i + 1]]
            first, last = self.own_from[found], self.own_from[found + 1]
            if (last - first).sum() < (self.start[lists + 1] - self.start[lists]).sum():
                pick = _ranges(first, last)
                row = np.repeat(np.arange(len(found)), last - first)
                asks[lists] = True
                hit = asks[self.own_term[pick]]
                asks[lists] = False
                scores = np.bincount(row[hit], self.part[self.own_at[pick[hit]]], len(found))
            else:  # many that score alike
                pick = _ranges(self.start[lists], self.start[lists + 1])
                scores = np.bincount(self.doc[pick], self.part[pick], docs)[found]
            out.append(top(self.ids[found], scores, k))
        return out

    def search(self, query: int, terms: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents but the query's own; terms in rising order, ties to the smaller id."""
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == terms] if len(self.terms) else at[:0]
        if not len(at):
            return best_ids, best
        spans = list(zip(self.list_from[at].tolist(), self.list_from[at + 1].tolist()))
        of = np.concatenate([self.block[lo:hi] for lo, hi in spans])  # the blocks of the query's lists
        bound = np.bincount(of, np.concatenate([self.most[lo:hi] for lo, hi in spans]), self.blocks) * (1 + 1e-9)  # sums in another order may round up

        def score(chosen):
            nonlocal best_ids, best
            visit = np.zeros(self.blocks, bool)
            visit[chosen] = True
            if 3 * len(chosen) > self.blocks:  # much of every list: cheaper taken whole
                whole = list(zip(self.start[at].tolist(), self.start[at + 1].tolist()))
                doc, part = np.concatenate([self.doc[lo:hi] for lo, hi in whole]), np.concatenate([self.part[lo:hi] for lo, hi in whole])
            else:
                lists = np.concatenate([np.arange(lo, hi) for lo, hi in spans])[visit[of]]
                pick = _ranges(self.block_from[lists], self.block_from[lists + 1])
                doc, part = self.doc[pick], self.part[pick]
            total = np.bincount(doc, part, len(self.ids))
            found = np.flatnonzero(total >= (best[-1] if len(best) == k else 1e-300))
            found = found[visit[found // RANGE] & self.known[found] & (self.ids[found] != query)]
            best_ids, best = top(np.concatenate([best_ids, self.ids[found]]), np.concatenate([best, total[found]]), k)

        highest = np.argpartition(-bound, min(FIRST, self.blocks) - 1)[:FIRST]
        score(highest)
        left = bound > 0
        left[highest] = False
        ahead, step = np.flatnonzero(left), 16
        while len(ahead):
            if len(best) == k:  # skip to the pivots
                ahead = ahead[bound[ahead] >= best[-1]]
            if 2 * len(ahead) > self.blocks:  # little can be skipped
                step = len(ahead)
            if len(ahead):
                score(ahead[:step])
            ahead, step = ahead[step:], 4 * step
        return best_ids, best


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, one entry an id, ties to the smaller."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of every query.

    ``queries`` has query_id, term, idf, the same for a term in every query. Only documents with a query term are
    returned, so a query may get fewer; a row with the query's id is not. Of
    rows that share an id the best counts; rows without one are counted in all
    statistics but not returned. Ties go to the smaller id. Queries are taken
    in blocks of about ``QUERY_TERMS`` terms, one after the other, each
    broadcast and searched in all shards.
    """
    spark = index.sparkSession
    n, words = index.agg(F.sum("docs"), F.sum("words")).first()
    mean = max((words or 0) / n, 1e-9) if n else 1.0
    blocks = max(1, -(-queries.count() // QUERY_TERMS))
    # a file a block, so that each is read alone
    queries = written(queries.select("query_id", "term", "idf", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).repartitionByRange(blocks, "block"), "queries")
    # a task keeps the best of all its shards: what tasks return grows with the queries only
    tasks, parts = 2 * spark.sparkContext.defaultParallelism, []
    for block in range(blocks):
        asking = queries.where(F.col("block") == block).select("query_id", "term", "idf").toArrow()
        ids, term, weight = (c.to_numpy() for c in asking.columns)
        term = term.view(np.uint64)
        order = np.lexsort((term, ids))
        sent = spark.sparkContext.broadcast((ids[order], term[order], weight[order]))

        def run(batches, sent=sent):
            import pyarrow as pa

            ids, term, weight = sent.value
            cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            ends = [*cut[1:].tolist(), len(ids)]
            asked, first = np.unique(term, return_index=True)
            best: dict[int, tuple] = {}
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard({name: b.column(name)[i].as_buffer() for name in ARRAYS}, mean, asked, weight[first])
                    asking = [(int(ids[lo]), term[lo:hi]) for lo, hi in zip(cut.tolist(), ends)]
                    beaten = [best[q][1][-1] if q in best and len(best[q][1]) == k else 0.0 for q, _ in asking]
                    for (q, _), found in zip(asking, shard.search_many(asking, beaten, k)):
                        if len(found[0]):
                            old = best.get(q)
                            best[q] = found if old is None else top(np.concatenate([old[0], found[0]]), np.concatenate([old[1], found[1]]), k)
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(list(best), np.int64), [len(a) for a, _ in best.values()])), pa.array(np.concatenate([a for a, _ in best.values()])), pa.array(np.concatenate([s for _, s in best.values()]))],
                    ["query_id", "doc_id", "score"])

        # stored before the next block is read, so that the driver never holds two
        parts.append(written(index.select(ARRAYS).coalesce(tasks).mapInArrow(run, "query_id long, doc_id long, score double"), "hits", **ALONE))
        sent.destroy()
    drop(queries)
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    by_query = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return merged.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_by_document(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` documents of ``docs`` most like each of ``queries`` (both doc_id, text).

    A query is every distinct term of its whole text, with the whole corpus's
    frequencies. A null or empty text asks nothing and, among ``docs``, is never
    found; rows of ``queries`` that share an id ask together, each term once.
    """
    index = build_index(docs)
    n = index.agg(F.sum("docs")).first()[0] or 0
    terms = query_terms(term_counts(queries.where("doc_id is not null")), document_frequencies(index), n)
    return search(index, terms, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search_by_document(docs, docs.where("doc_id % 100 = 0"))
    return found.withColumn("score", F.round("score", 6))


ORACLE_SQL = r"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM word GROUP BY doc_id, w),
len AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
n AS (SELECT count(*)::DOUBLE AS docs, (SELECT count(*) FROM word) / count(*)::DOUBLE AS mean FROM documents),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len.n / mean))) AS score
  FROM tf q JOIN df USING (w) JOIN tf t USING (w) JOIN len ON len.doc_id = t.doc_id CROSS JOIN n WHERE q.doc_id % 100 = 0 AND t.doc_id <> q.doc_id GROUP BY q.doc_id, t.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""
