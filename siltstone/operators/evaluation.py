"""Search quality: grades of hits against ground truth, metrics by variant, run comparison.

Hits: query_id, variant, position, id, text. Truth: fragments (query_id,
fragment, gain) and documents (query_id, id, gain) with gains 1, 0.5 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns
from .inspection import upper_median


def graded(hits: DataFrame, documents: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """Hits with gain (null: not graded): the best of the fragments its text contains, else of its id."""
    by_id = documents.groupBy("query_id", "id").agg(F.max("gain").alias("_by_id"))
    out = hits.join(by_id, ["query_id", "id"], "left")
    if fragments is None:
        return out.withColumnRenamed("_by_id", "gain")
    f = fragments.select("query_id", T.folded(F.col("fragment")).alias("_f"), F.col("gain").alias("_g"))
    found = hits.join(f, "query_id").where(F.contains(T.folded(F.col("text")), F.col("_f"))).groupBy("query_id", "variant", "position").agg(F.max("_g").alias("_by_text"))
    return out.join(found, ["query_id", "variant", "position"], "left").withColumn("gain", F.coalesce(F.greatest("_by_text", "_by_id"), "_by_text", "_by_id")).drop("_by_text", "_by_id")


def _per_query(graded_hits: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """One row per (query_id, variant) of ``queries`` (query_id, variant), those without hits too."""
    at = F.col("position")
    positive = F.coalesce(F.col("gain"), F.lit(0.0)) > 0
    agg = graded_hits.groupBy("query_id", "variant").agg(
        F.min(F.when(positive, at)).alias("first"),
        *[F.max(F.when((at <= k) & positive, 1).otherwise(0)).alias(f"hit_{k}") for k in ks],
        *[F.count_if((at <= k) & positive).alias(f"found_{k}") for k in ks],
        *[F.sum(F.when((at <= k) & positive, F.col("gain") / F.log2(at + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
        *[F.filter(F.collect_list(F.when((at <= k) & positive, F.col("gain"))), lambda g: g > 0).alias(f"gains_{k}") for k in ks],
    )
    return queries.join(agg, ["query_id", "variant"], "left")


def metrics(hits: DataFrame, truth: DataFrame, cells: DataFrame, ks: list[int] = (1, 5, 10)) -> DataFrame:
    """(variant, metric, k, value): hit rate, recall, nDCG at each k, and MRR (k = 0).

    ``truth``: (query_id, id, gain) of documents; ``hits`` have gain (see
    ``graded``); ``cells``: (query_id, variant) that ran without failure. Queries
    without relevant truth are left out; for recall, those without known
    documents. A query whose ideal is 0 adds 0 to nDCG but counts.
    """
    known = truth.where("gain > 0").groupBy("query_id").agg(F.count("*").alias("known"), F.max("gain").alias("best"), F.collect_list("gain").alias("truth_gains"))
    missed = truth.where("gain > 0").join(cells, "query_id")
    base = _per_query(hits, cells, list(ks)).join(known, "query_id", "left").where("best is not null")
    cols = []
    for k in ks:
        seen = hits.where((F.col("position") <= k) & (F.col("gain") > 0)).select("query_id", "variant", "id").distinct()
        lost = missed.join(seen, ["query_id", "variant", "id"], "left_anti").groupBy("query_id", "variant").agg(F.collect_list("gain").alias(f"lost_{k}"))
        base = base.join(lost, ["query_id", "variant"], "left")
        gains = F.concat(F.coalesce(F.col(f"gains_{k}"), F.array().cast("array<double>")), F.coalesce(F.col(f"lost_{k}"), F.array().cast("array<double>")))
        ideal = F.aggregate(F.transform(F.slice(F.sort_array(gains, False), 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
        ndcg = F.when(ideal > 0, F.least(F.lit(1.0), F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal)).otherwise(0.0)
        cols += [("hit_rate", k, F.avg(F.coalesce(F.col(f"hit_{k}"), F.lit(0)).cast("double"))), ("recall", k, F.avg(F.least(F.lit(1.0), F.coalesce(F.col(f"found_{k}"), F.lit(0)) / F.col("known")))), ("ndcg", k, F.avg(ndcg))]
    cols.append(("mrr", 0, F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))))
    wide = base.groupBy("variant").agg(*[c.alias(f"m{i}") for i, (_, _, c) in enumerate(cols)])
    return wide.select("variant", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"m{i}").alias("value")) for i, (m, k, _) in enumerate(cols)])).alias("r")).select("variant", "r.*")


def latency(cells: DataFrame, seconds: str, keys: list[str]) -> DataFrame:
    """(keys, n, median, p95) by nearest rank."""
    return cells.groupBy(*keys).agg(F.count(seconds).alias("n"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {seconds})").alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {seconds})").alias("p95"))


def best_cells(table: DataFrame, keys: list[str], value: str, lower_is_better: bool = False) -> DataFrame:
    """The table with ``best``: the extreme of each column; none if all are equal or fewer than two present."""
    stats = table.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    edge = F.col("_lo") if lower_is_better else F.col("_hi")
    best = (F.col("_n") >= 2) & (F.col("_lo") != F.col("_hi")) & (F.col(value) == edge)
    return table.join(stats, keys).withColumn("best", F.coalesce(best, F.lit(False))).drop("_lo", "_hi", "_n")


def outcomes(hits: DataFrame, cells: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """(query_id, variant, outcome, rank): found, missed (rank n + 1) or unmarked (no relevant truth)."""
    first = hits.where("gain > 0").groupBy("query_id", "variant").agg(F.min("position").alias("first"))
    marked = truth.where("gain > 0").select("query_id").distinct().withColumn("_marked", F.lit(True))
    out = cells.join(first, ["query_id", "variant"], "left").join(marked, "query_id", "left")
    outcome = F.when(F.col("_marked").isNull(), "unmarked").when(F.col("first").isNull(), "missed").otherwise("found")
    return out.select("query_id", "variant", outcome.alias("outcome"), F.when(outcome == "missed", n + 1).when(outcome == "found", F.col("first")).alias("rank"))


def most_divergent(results: DataFrame, texts: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, text, spread): queries whose rank differs most between variants, ties by text, last first."""
    spread = results.where("rank is not null").groupBy("query_id").agg((F.max("rank") - F.min("rank")).alias("spread")).where("spread > 0")
    return spread.join(texts, "query_id").orderBy(F.desc("spread"), F.desc("text")).limit(most)


def deltas(before: DataFrame, after: DataFrame, visible: float = 0.005, lower_is_better: Column | None = None) -> DataFrame:
    """(variant, metric, k, before, after, delta, improved): null improved where the change is too small to see or one run lacks the variant."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    out = a.join(b, ["variant", "metric", "k"], "full").withColumn("delta", F.col("after") - F.col("before"))
    sign = F.col("delta") if lower_is_better is None else F.when(lower_is_better, -F.col("delta")).otherwise(F.col("delta"))
    return out.withColumn("improved", F.when(F.abs("delta") >= visible, sign > 0))


def variants(before: DataFrame, after: DataFrame) -> DataFrame:
    """(variant, side): which variants two runs (variant, …) have: both, or only the one before or after."""
    a, b = (x.select("variant").distinct().withColumn(n, F.lit(True)) for x, n in ((before, "_a"), (after, "_b")))
    return a.join(b, "variant", "full").select("variant", F.when(F.col("_b").isNull(), "before").when(F.col("_a").isNull(), "after").otherwise("both").alias("side"))


def coverage(hits: DataFrame, keys: list[str] = ("variant",)) -> DataFrame:
    """(keys, hits, graded, relevant, partial, irrelevant)."""
    g = F.col("gain")
    return hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.count(g).alias("graded"), F.count_if(g >= 1).alias("relevant"), F.count_if((g > 0) & (g < 1)).alias("partial"), F.count_if(g == 0).alias("irrelevant"))


def containing(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(item_id, doc_id): which documents (doc_id, t) contain which fragments (item_id, f), both folded; one pass finds all fragments of a text."""
    return patterns.containing(docs, fragments)


def median_lengths(hits: DataFrame) -> DataFrame:
    """(variant, median): the upper median of the lengths of a variant's texts."""
    return upper_median(hits.where(F.col("text").isNotNull()).select("variant", F.length("text").alias("length")), "length", ["variant"])


def length_caveat(medians: DataFrame, ratio: float = 2.0) -> DataFrame:
    """One row (shortest, longest, caveat) where the variants' median lengths differ by the ratio or more, else none."""
    ends = medians.agg(F.min_by("variant", F.struct("median", "variant")).alias("shortest"), F.min("median").alias("_low"), F.max_by("variant", F.struct("median", "variant")).alias("longest"), F.max("median").alias("_high"), F.count("*").alias("_n"))
    much = (F.col("_n") > 1) & (F.col("_low") > 0) & (F.col("_high") >= ratio * F.col("_low"))
    return ends.where(much).select("shortest", "longest", F.format_string("median lengths from %d to %d: longer texts contain a fragment more often", "_low", "_high").alias("caveat"))


def judge_coverage(hits: DataFrame, judgements: DataFrame) -> DataFrame:
    """One row (hits, judged, left, relevant, partial, irrelevant): how far a judge's grades (query_id, variant, id, grade) cover the hits."""
    own = judgements.groupBy("query_id", "variant", "id").agg(F.max("grade").alias("grade"))
    both = hits.select("query_id", "variant", "id").join(own, ["query_id", "variant", "id"], "left")
    grades = [F.count_if(F.col("grade") == g).alias(g) for g in ("relevant", "partial", "irrelevant")]
    return both.agg(F.count("*").alias("hits"), F.count("grade").alias("judged"), F.count_if(F.col("grade").isNull()).alias("left"), *grades)


def strict(graded_hits: DataFrame, marked: DataFrame, short: int = 200) -> DataFrame:
    """Each marked query of each variant: (query_id, variant, answerable, rr, hit_1, hit_3, junk_3, short_5, unmarked).

    ``graded_hits`` have gain (1 relevant, 0.5 partial, 0 irrelevant, null not
    marked) and n_chars, ``marked`` (query_id, answerable). Only a fully
    relevant hit counts for ``rr``, its reciprocal rank.
    """
    at, gain = F.col("position"), F.col("gain")
    per = graded_hits.join(marked, "query_id").groupBy("query_id", "variant", "answerable")
    return per.agg(
        F.coalesce(1 / F.min(F.when(gain == 1, at)), F.lit(0.0)).alias("rr"), F.max(F.when((at == 1) & (gain > 0), 1).otherwise(0)).alias("hit_1"), F.max(F.when((at <= 3) & (gain > 0), 1).otherwise(0)).alias("hit_3"),
        F.count_if((at <= 3) & (gain == 0)).alias("junk_3"), F.count_if((at <= 5) & (F.col("n_chars") < short)).alias("short_5"), F.count_if(gain.isNull()).alias("unmarked"))


def strict_summary(per_query: DataFrame) -> DataFrame:
    """(variant, mrr, hit_1, hit_3, junk_3, short_5, unmarked): means; the first three over answerable queries."""
    good = F.col("answerable")
    return per_query.groupBy("variant").agg(*[F.avg(F.when(good, F.col(c))).alias(n) for c, n in (("rr", "mrr"), ("hit_1", "hit_1"), ("hit_3", "hit_3"))], *[F.avg(c).alias(c) for c in ("junk_3", "short_5", "unmarked")])


def pairwise(per_query: DataFrame, base: str) -> DataFrame:
    """(variant, better, worse, same): answerable queries by reciprocal rank against the base variant."""
    own = per_query.where("answerable").select("query_id", "variant", "rr")
    was = own.where(F.col("variant") == base).select("query_id", F.col("rr").alias("was"))
    both = own.where(F.col("variant") != base).join(was, "query_id", "left").withColumn("was", F.coalesce("was", F.lit(0.0)))
    return both.groupBy("variant").agg(F.count_if(F.col("rr") > F.col("was")).alias("better"), F.count_if(F.col("rr") < F.col("was")).alias("worse"), F.count_if(F.col("rr") == F.col("was")).alias("same"))


def simulated(outcomes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, value): the mean over queries (on, off: outcomes with and without a stage) if the rule decides which one counts."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.when(use, F.col("on")).otherwise(F.col("off")).alias("value")) for name, use in rules.items()])
    return outcomes.select(F.explode(each).alias("r")).groupBy("r.rule").agg(F.avg("r.value").alias("value"))


def report(summary: DataFrame, title: str) -> tuple[str, dict]:
    """A table of metrics (variant, metric, k, value), as Markdown with the best of each row in bold, and as a dictionary for JSON."""
    rows = summary.orderBy("metric", "k", "variant").collect()  # a row a metric and variant
    variants = list(dict.fromkeys(r["variant"] for r in rows))
    table: dict[tuple, dict] = {}
    for r in rows:
        table.setdefault((r["metric"], r["k"]), {})[r["variant"]] = r["value"]
    lines = [f"# {title}", "", "| metric | " + " | ".join(v.replace("|", "\\|") for v in variants) + " |", "|---|" + "---|" * len(variants)]
    for (metric, k), cells in table.items():
        best = max((v for v in cells.values() if v is not None), default=None)
        shown = ["" if cells.get(v) is None else f"**{cells[v]:.3f}**" if cells[v] == best else f"{cells[v]:.3f}" for v in variants]
        lines.append(f"| {metric}{f'@{k}' if k else ''} | " + " | ".join(shown) + " |")
    return "\n".join(lines) + "\n", {"title": title, "variants": variants, "metrics": [{"metric": m, "k": k, "values": c} for (m, k), c in table.items()]}
