"""Search as one plan: a profile says which stages run, each query batch becomes one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diversity, filters, knn, retrieval


@dataclass(frozen=True)
class SearchProfile:
    """Which stages run, and how. The defaults are plain hybrid search."""

    n_results: int = 10
    metric: str = "cosine"
    use_text: bool = True
    text_max_words: int | None = None
    vector_weight: float = 1.0
    text_weight: float = 1.0
    rrf_k: int = 60
    minimum_length: int | None = None
    length_target: int | None = None
    length_power: float = 0.5
    collapse_parents: bool = False
    collapse_copies: bool = False
    diversity: float | None = None
    promotion: str = "child"
    context_window: int = 0
    use_marks: bool = False
    level_scope: str = "all"
    query_prefix: str = ""  # put before the query's text where it is embedded
    rerank_head: int = 0  # hits that a judge puts in order
    pool_multiplier: int = 5
    where: dict | None = None

    def stages(self) -> list[str]:
        on = {
            "candidates": True, "length": self.minimum_length or self.length_target, "fusion": self.use_text,
            "collapse": self.collapse_parents or self.collapse_copies, "diversity": self.diversity is not None,
            "promote": self.promotion != "child", "context": self.context_window > 0, "rerank": self.rerank_head > 0, "marks": self.use_marks, "truncate": True,
        }
        return [k for k, v in on.items() if v]

    def pool(self) -> int:
        discards = bool(self.minimum_length or self.length_target or self.collapse_parents or self.collapse_copies or self.diversity is not None or self.use_text)
        return retrieval.pool_size(self.n_results, discards, self.pool_multiplier)

    def text_runs(self, query: str) -> bool:
        """Text search joins in only for queries of few words, if so set."""
        return self.use_text and (self.text_max_words is None or T.word_count(query) <= self.text_max_words)


def hybrid_search(docs: DataFrame, query_text: str, query_vector: DataFrame | None, profile: SearchProfile = SearchProfile(), parents: DataFrame | None = None, query_id: int = 0, embed=None, judge=None, vectors: DataFrame | None = None, places: DataFrame | None = None, with_vector: bool = False) -> DataFrame:
    """Ranked hits of one query over ``docs`` (id, document, embedding, metadata): query_id, position, id, document, distance, relevance, sources.

    Where vectors are stored apart, ``vectors`` (id, embedding) gives them: then
    they meet the documents by id only, and payloads are fetched for the fused
    hits alone, which are at most two pools and are broadcast. ``with_vector``
    then leaves out documents without one. ``places`` (id and columns such as
    file, chunk_index and parent_id) are given apart where they are numbered over
    many rows, which need not carry their texts for that.

    ``query_vector`` has id and embedding (one row). Without it ``embed``, a
    function of a list of texts, is asked for the vector of the query behind the
    profile's prefix; without either only the text is searched. ``judge`` turns
    the first hits (query_id, id, document) into their scores (query_id, id,
    score). Context needs the columns file and chunk_index.
    """
    if query_vector is None and embed is not None:
        vector = [float(x) for x in embed([profile.query_prefix + query_text])[0]]
        query_vector = docs.sparkSession.createDataFrame([(query_id, vector)], "id long, embedding array<double>")
    rows = docs.where(filters.where(profile.where))
    if "chunk_level" in docs.columns:
        rows = rows.where(filters.level_scope(profile.level_scope, F.col("chunk_level")))
    if profile.minimum_length:
        rows = retrieval.long_enough(rows, profile.minimum_length)
    pool, lists = profile.pool(), []
    if query_vector is not None:
        kept = rows.select("id", "embedding") if vectors is None else vectors.select("id", "embedding").join(rows.select("id"), "id", "left_semi")
        near = knn.nearest(kept, query_vector, pool, profile.metric).withColumn("query_id", F.lit(query_id).cast("long"))
        lists.append((near.select("query_id", "id", "position", "distance"), profile.vector_weight))
    if profile.text_runs(query_text) or query_vector is None:
        texts = rows.join(vectors.select("id"), "id", "left_semi") if with_vector and vectors is not None else rows
        found = retrieval.text_candidates(texts, query_text, pool, headings="heading_path" if "heading_path" in texts.columns else None)
        lists.append((found.select(F.lit(query_id).cast("long").alias("query_id"), "id", "position"), profile.text_weight))
    hits = retrieval.fuse(lists, profile.rrf_k, keep=["distance"])
    if query_vector is None:
        hits = hits.withColumn("distance", F.lit(None).cast("double"))
    if places is not None:
        hits = places.join(F.broadcast(hits), "id")
    hits = rows.join(F.broadcast(hits), "id")
    if vectors is not None and profile.diversity is not None:
        hits = vectors.select("id", "embedding").join(F.broadcast(hits), "id", "right")
    if profile.length_target:
        hits = retrieval.prefer_length(hits, profile.length_target, profile.length_power)
    if profile.collapse_parents:
        hits = retrieval.collapse_parents(hits)
    if profile.collapse_copies:
        hits = retrieval.collapse_copies(hits)
    if profile.diversity is not None:
        chosen = diversity.diversify(hits, profile.n_results, profile.diversity)
        hits = hits.drop("position").join(chosen, ["query_id", "id"])
    if profile.promotion != "child" and parents is not None:
        hits = retrieval.promote(hits, parents, profile.promotion)
    if profile.context_window > 0 and {"file", "chunk_index"} <= set(hits.columns):
        hits = retrieval.in_context(hits, rows, profile.context_window)
    if profile.rerank_head > 0 and judge is not None:
        hits = retrieval.reorder(hits, judge(retrieval.first_n(hits, profile.rerank_head).select("query_id", "id", "document")), profile.rerank_head)
    if profile.use_marks and "mark" in hits.columns:
        hits = retrieval.apply_marks(hits)
    sources = F.transform("placements", lambda p: F.when(p["list"] == 0, F.lit("vector" if query_vector is not None else "text")).otherwise("text"))
    return retrieval.first_n(hits, profile.n_results).withColumn("sources", sources).drop("placements")


def multi_collection(results: dict[str, tuple[DataFrame, float]], n: int = 10, k: int = 60) -> DataFrame:
    """Hits of several collections (query_id, id, position) fused by (collection, id) with weights."""
    lists = [(df.withColumn("collection", F.lit(name)), w) for name, (df, w) in results.items()]
    return retrieval.first_n(retrieval.fuse(lists, k, ["query_id", "collection", "id"]), n)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of the frames between stages: what a search reports about itself."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
