"""Stages of retrieval as DataFrame steps; every window is partitioned by query.

A ranked list has query_id, id and position (from 1); scores ride along. Stages
keep the columns they do not name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K = 60
LEAST = 5e-324  # the least positive double: a count divided by it is infinite, and 0 stays 0


def pool_size(n: int, discards: bool, multiplier: int = 5, least: int = 20) -> int:
    """Candidates to fetch so that ``n`` (1 to 100) are left after stages that discard."""
    n = min(max(n, 1), 100)
    return max(n, least, n * multiplier) if discards else n


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def text_candidates(docs: DataFrame, query: str, pool: int | None = None, whole: bool = False, headings: str | None = None, query_id: int = 0) -> DataFrame:
    """Documents (id, document) that hold a term of ``query``, best first: query_id, id, score, relevance, position.

    A term's weight is its inverse document frequency among the matches (1 for a
    single term). A document scores its occurrences, a heading that holds the
    term counts twice, over the square root of the length; a term asked twice
    counts twice. An empty text is found by its heading only, with an infinite
    score. All matches are ranked before the pool is cut; without a pool
    whoever reads ``position`` has all of them numbered in one task.
    """
    words = T.query_terms(query, whole)
    if not words:
        return docs.select(F.lit(query_id).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0.0).alias("relevance"), F.lit(1).alias("position")).limit(0)
    distinct = list(dict.fromkeys(T.fold_word(w) for w in words))
    head = F.coalesce(T.folded(F.col(headings)), F.lit("")) if headings else F.lit("")
    # white space matters only to terms that hold some
    body = T.folded(F.col("document")) if any(w.split() != [w] for w in distinct) else T.unmarked(F.col("document"))
    # what a heading gives to an empty text is beyond all finite scores
    n = F.length("document").cast("double")
    texts = F.array(F.struct(body.alias("body"), head.alias("head"), F.when(n > 0, F.sqrt(n)).otherwise(F.lit(LEAST)).alias("n")))

    def counted(t):
        return F.array(*[(T.occurrences(t["body"], F.lit(w)) + 2 * F.contains(t["head"], F.lit(w)).cast("int")) / t["n"] for w in distinct])

    # a generator folds each text once and gives a row only where a term occurs
    found = F.explode(F.filter(F.transform(texts, counted), lambda c: F.exists(c, lambda x: x > 0)))
    # statistics and scores read one exchange of what matched
    matched = docs.where(F.col("document").isNotNull()).select("id", found.alias("parts")).repartition("id")
    if len(distinct) > 1:
        stats = matched.agg(F.count("id").alias("_n"), *[F.count_if(F.col("parts")[i] > 0).alias(f"_d{i}") for i in range(len(distinct))])
        matched = matched.crossJoin(F.broadcast(stats))  # one row
        weight = [F.greatest(F.lit(0.05), F.log(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))) for i in range(len(distinct))]
    else:
        weight = [F.lit(1.0)]
    part = {w: F.col("parts")[i] * weight[i] for i, w in enumerate(distinct)}
    score = reduce(lambda a, b: a + b, [part[T.fold_word(w)] for w in words])
    scored = matched.select(F.lit(query_id).alias("query_id"), "id", score.alias("score")).where("score > 0")
    if pool:
        best = ranked(scored.orderBy(F.desc("score"), "id").limit(pool), F.desc("score"), "id")
        return best.withColumn("relevance", F.col("score") / F.max("score").over(W.partitionBy("query_id")))
    most = scored.agg(F.max("score").alias("_most"))
    out = ranked(scored, F.desc("score"), "id").crossJoin(F.broadcast(most))  # one row
    return out.withColumn("relevance", F.col("score") / F.col("_most")).drop("_most")


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K, key: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists with weights: query_id, id, score, relevance, position, placements.

    Ties go to what was seen first: list by list, then by position. Columns of
    ``keep``, which at most one list has, come along.
    """
    key = key or ["query_id", "id"]
    held = [df.select(*key, "position", F.lit(i).alias("list"), F.lit(float(w)).alias("weight"), *(c for c in keep if c in df.columns)) for i, (df, w) in enumerate(lists)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held)
    placed = F.struct("list", "position")
    fused = union.groupBy(*key).agg(F.sum(F.col("weight") / (F.lit(k) + F.col("position"))).alias("score"), F.min(placed).alias("_first"), F.array_sort(F.collect_list(placed)).alias("placements"), *(F.max(c).alias(c) for c in keep if c in union.columns))
    fused = fused.withColumn("score", F.round("score", 12))
    return ranked(fused, F.desc("score"), "_first").withColumn("relevance", F.col("score") / F.max("score").over(W.partitionBy("query_id"))).drop("_first")


def long_enough(hits: DataFrame, least: int) -> DataFrame:
    """The length filter, for each candidate list before fusion."""
    return hits.where(F.length("document") >= least)


def prefer_length(hits: DataFrame, target: int, power: float = 0.5) -> DataFrame:
    """Short texts weighed down by ``(length / target) ** power`` and re-sorted; hits without relevance keep their places."""
    n = F.length("document")
    hits = hits.withColumn("relevance", F.when(n < target, F.col("relevance") * F.pow(n / F.lit(target), F.lit(power))).otherwise(F.col("relevance")))
    scored = F.col("relevance").isNotNull()
    slots = hits.withColumn("_slot", F.row_number().over(W.partitionBy("query_id", scored).orderBy("position")))
    slots = slots.withColumn("_order", F.row_number().over(W.partitionBy("query_id", scored).orderBy(F.desc("relevance"), "position")))
    # the n-th scored hit takes the place the n-th scored one had
    free = slots.where(scored).select("query_id", F.col("_slot").alias("_order"), F.col("position").alias("_place"))
    moved = slots.where(scored).join(free, ["query_id", "_order"])
    still = slots.where(~scored).withColumn("_place", F.col("position"))
    return moved.unionByName(still).withColumn("position", F.col("_place")).drop("_slot", "_order", "_place")


def collapse_parents(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The first hit of each parent, with how many it stands for besides itself and the smallest distance."""
    key = W.partitionBy("query_id", F.coalesce(F.col(parent).cast("string"), F.concat(F.lit("\0"), F.col("id").cast("string"))))
    out = hits.withColumn("_n", F.row_number().over(key.orderBy("position"))).withColumn("collapsed", F.count("*").over(key) - 1)
    if "distance" in hits.columns:
        out = out.withColumn("distance", F.min("distance").over(key))
    return renumbered(out.where("_n = 1").drop("_n"))


def collapse_copies(hits: DataFrame, exempt: Column | None = None) -> DataFrame:
    """The first hit of each text (white space aside); empty texts and table rows (``exempt``) all stay."""
    same = T.collapsed(F.col("document"))
    free = F.coalesce(same, F.lit("")) == ""
    free = free if exempt is None else free | F.coalesce(exempt, F.lit(False))
    key = F.when(free, F.concat(F.lit("\0"), F.col("id").cast("string"))).otherwise(F.sha2(same, 256))
    return renumbered(hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id", key).orderBy("position"))).where("_n = 1").drop("_n"))


def renumbered(hits: DataFrame) -> DataFrame:
    return ranked(hits, "position")


def promote(hits: DataFrame, parents: DataFrame, mode: str = "parent", parent: str = "parent_id") -> DataFrame:
    """Parents (id, document) in place of (parent), beside (both) or not at all (child); a missing parent leaves the hit."""
    if mode == "child":
        return hits
    p = parents.select(F.col("id").alias(parent), F.col("document").alias("_text"))
    found = hits.join(p, parent, "left")
    if mode == "both":
        return found.withColumnRenamed("_text", "parent_document")
    took = F.col("_text").isNotNull()
    return found.withColumn("matched_id", F.when(took, F.col("id"))).withColumn("document", F.coalesce("_text", "document")).withColumn("id", F.when(took, F.col(parent)).otherwise(F.col("id"))).drop("_text")


def with_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, file: str = "file") -> DataFrame:
    """Chunks (id, file, chunk_index, document) around each hit, up to ``window`` (at most 3) on each side to the first gap.

    query_id, hit_id, id, chunk_index, offset. Chunks that are hits of the query
    themselves are left out but do not end the run.
    """
    window = min(max(window, 0), 3)
    near = hits.select("query_id", F.col("id").alias("hit_id"), file, F.col("chunk_index").alias("_at"))
    wanted = near.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in range(-window, window + 1) if o]))) if window else near.withColumn("offset", F.lit(1)).limit(0)
    wanted = wanted.withColumn("chunk_index", F.col("_at") + F.col("offset"))
    found = wanted.join(chunks.select("id", file, "chunk_index"), [file, "chunk_index"])
    # present all the way from the hit: as many found as the distance
    side = W.partitionBy("query_id", "hit_id", F.signum("offset")).orderBy(F.abs("offset")).rowsBetween(W.unboundedPreceding, 0)
    run = found.withColumn("_run", F.count("*").over(side)).where(F.col("_run") == F.abs("offset"))
    own = hits.select("query_id", "id").distinct()
    return run.join(own, ["query_id", "id"], "left_anti").select("query_id", "hit_id", "id", "chunk_index", "offset")


def apply_marks(hits: DataFrame, mark: str = "mark") -> DataFrame:
    """Pinned hits first, then unmarked, demoted and stale ones, each group in its order."""
    return regrouped(hits, F.when(F.col(mark) == "pinned", 0).when(F.col(mark) == "demoted", 2).when(F.col(mark) == "stale", 3).otherwise(1))


def regrouped(hits: DataFrame, group: Column) -> DataFrame:
    """Hits by group, within a group in the order they had."""
    return ranked(hits, group, "position")


def changed_nothing(stages: DataFrame) -> DataFrame:
    """One row (unchanged): whether none of the optional stages that ran (stage, ran, rows_in, rows_out) can have changed the result.

    Collapsing and marks that kept every row changed nothing; any other stage that ran may have moved rows.
    """
    idle = ~F.col("ran") | (F.col("stage").isin("collapse", "marks") & (F.col("rows_in") == F.col("rows_out")))
    return stages.agg(F.coalesce(F.bool_and(idle), F.lit(True)).alias("unchanged"))


def in_context(hits: DataFrame, chunks: DataFrame, window: int, file: str = "file") -> DataFrame:
    """Hits with ``context``: the neighbouring chunks (offset, id, document) up to ``window`` on each side."""
    near = with_neighbours(hits, chunks, window, file).join(chunks.select("id", "document"), "id")
    held = near.groupBy("query_id", F.col("hit_id").alias("_hit")).agg(F.array_sort(F.collect_list(F.struct("offset", "id", "document"))).alias("context"))
    return hits.join(held.withColumnRenamed("_hit", "id"), ["query_id", "id"], "left")


def pinned_beyond(hits: DataFrame, docs: DataFrame, most: int = 20, mark: str = "mark") -> DataFrame:
    """The first ``most`` pinned documents that are not hits, behind each query's hits."""
    first = docs.where(F.col(mark) == "pinned").orderBy("id").limit(most)
    ends = hits.groupBy("query_id").agg(F.max("position").alias("_last"))
    add = ends.crossJoin(F.broadcast(first)).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    add = add.withColumn("position", F.col("_last") + F.row_number().over(W.partitionBy("query_id").orderBy("id"))).drop("_last")
    return hits.unionByName(add, allowMissingColumns=True)


def reorder(hits: DataFrame, verdicts: DataFrame, head: int = 20) -> DataFrame:
    """By a reranker's score (query_id, id, score) within the first ``head``; what it did not mention follows in order."""
    joined = hits.join(verdicts.select("query_id", "id", F.col("score").alias("_score")), ["query_id", "id"], "left")
    inside = F.col("position") <= head
    return ranked(joined, F.when(inside, 0).otherwise(1), F.when(inside, F.col("_score")).desc_nulls_last(), "position").withColumnRenamed("_score", "rerank_score")


def parsed_score(answer: Column) -> Column:
    """A cross-encoder's answer: a number, or yes and no in two languages; null if unclear."""
    t = F.lower(F.trim(answer))
    return F.when(t.rlike(r"^(yes|да|true)\b"), 1.0).when(t.rlike(r"^(no|нет|false)\b"), 0.0).otherwise(F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))


def fair_shares(needs: list[int], budget: int) -> list[int]:
    """A budget divided so that nobody gets more than needed and all who get less get the same."""
    out, left, open_ = [0] * len(needs), budget, sorted(range(len(needs)), key=lambda i: needs[i])
    for n, i in enumerate(open_):
        out[i] = min(needs[i], left // (len(open_) - n))
        left -= out[i]
    return out


def first_n(hits: DataFrame, n: int) -> DataFrame:
    return hits.where(F.col("position") <= n)


def within_budget(hits: DataFrame, characters: int, text: str = "document") -> DataFrame:
    """Hits in order until their texts use up a budget; the last one is cut."""
    order = W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(order), F.lit(0))
    out = hits.withColumn("_used", used).where(F.col("_used") < characters)
    return out.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(characters) - F.col("_used")).cast("int"))).drop("_used")


def is_hierarchical(chunks: DataFrame, level: str = "chunk_level") -> DataFrame:
    """One row: whether both levels of chunks occur."""
    return chunks.agg((F.coalesce(F.bool_or(F.col(level) > 0), F.lit(False)) & F.coalesce(F.bool_or(F.col(level) == 0), F.lit(False))).alias("hierarchical"))


def history_after(history: DataFrame, asked: DataFrame, most: int = 1000) -> DataFrame:
    """Query history (text, pinned, at) with new queries: one row a folded text, unpinned ones beyond ``most`` dropped, oldest first."""
    every = history.unionByName(asked).withColumn("_key", T.folded(F.col("text")))
    same = W.partitionBy("_key")
    latest = every.withColumn("pinned", F.max("pinned").over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.desc("at"), "text"))).where("_n = 1").drop("_n", "_key")
    newest = latest.where(~F.col("pinned")).orderBy(F.desc("at"), "text").limit(most)
    return latest.where("pinned").unionByName(newest)
