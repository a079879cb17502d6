"""Mixing sources to target weights by capped water-filling.

Sources share the words of all documents by weight. A source that would be
repeated more than ``EPOCHS`` times is clamped there, and what it leaves goes
to the others by weight, until none is above its cap. Sources are clamped in
the order of cap by weight, so one scan in that order finds how many are. Each
document is then taken as often as its source is repeated in whole; the rest of
the target is filled with documents in a seeded order until it is met.

All steps are DataFrame operations. Running sums over sources go part by part
(``operators.ordered``), those over the documents of a source bucket by bucket,
so neither many sources nor one large source end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import read_table, repeated, written

EPOCHS = 3
WEIGHTS = [1, 2, 3]
SEED = "mix"
BUCKET_ROWS = 10_000  # documents that one group sums up in order, about
SPACE = " \t\n\x0b\f\r"


def word_count(text: str):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; no list of them is made."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), SPACE, "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size), one a source.

    Weights go round by code point of the source, null last. The targets sum up
    to all sizes, which is always feasible as no cap is below its source.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    placed = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.select("source", "source_size", weight.cast("long").alias("weight"))
    every = placed.agg(F.sum("weight")).first()[0] or 0
    # in the order of cap by weight: the first source that the rest of the words, by weight, would not lift above its cap is free, and so are all after it
    scanned = running(placed, [F.col("source_size") / F.col("weight")], {"clamped": epochs * F.col("source_size"), "weights": F.col("weight")})
    free = (F.lit(float(total)) - F.col("clamped")) * F.col("weight") <= epochs * F.col("source_size").cast("double") * (F.lit(float(every)) - F.col("weights"))
    first = scanned.where(free).agg(F.min(F.struct("weights", "clamped")).alias("at")).first()["at"]
    # words for each unit of weight of the free sources; with none free, all are at their caps
    level = float("inf") if first is None else (total - first["clamped"]) / (every - first["weights"])
    return placed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), epochs * F.col("source_size").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    A null or empty text has no words and takes none; a null source is a source
    of its own, an empty name another. Rows equal in id, source and size are
    counted once and come out each; of them some may be taken once more than
    others. Other columns are ignored; an empty table gives no rows. A source's
    ``taken`` differs from its target by half its largest document at most.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    rows = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")
    held = written(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, epochs), "targets")

    # the seeded order of a source's documents, cut into buckets by the first digits of their hashes
    n, digits = rows.count(), 0
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("hash", hashed).withColumn("bucket", F.substring("hash", 1, digits)).withColumn("words", F.col("size") * F.col("copies"))
    known = held.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "target")
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
    keys = ["name", "unnamed", "bucket"]
    buckets = rows.groupBy(*keys).agg(F.sum("words").alias("words"))
    buckets = running(buckets, [F.col("bucket")], {"before": F.col("words")}, keys=["name", "unnamed"]).drop("words").join(known, ["name", "unnamed"])
    within = W.partitionBy(*keys).orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("words").over(within), F.lit(0))).join(buckets, keys)

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    # a copy is taken once more while its middle lies within the rest of the target
    fit = F.when(F.col("size") > 0, F.floor((rest - F.col("before") - F.col("own")) / F.col("size") + 0.5)).otherwise(0)
    more = F.least(F.greatest(fit.cast("long"), F.lit(0).cast("long")), F.col("copies"))
    out = placed.select("doc_id", "size", "source_size", "target", "copies", whole.alias("whole"), more.alias("more"))
    lots = F.array(F.struct(F.col("more").alias("n"), ((F.col("whole") + 1) * F.col("size")).alias("taken")), F.struct((F.col("copies") - F.col("more")).alias("n"), (F.col("whole") * F.col("size")).alias("taken")))
    lots = out.select("doc_id", "size", "source_size", "target", F.explode(lots).alias("lot")).select("doc_id", "size", "source_size", "target", "lot.taken", "lot.n").where("n > 0")
    return repeated(lots, "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


#: The same in SQL: sources are clamped one after the other by running sums, documents taken in the order of their hashes.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS every,
  coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
  coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM s),
l AS (SELECT arg_min((total - clamped)::DOUBLE / (every - weights)::DOUBLE, weights) AS level FROM c WHERE (total - clamped) * weight <= 3 * source_size * (every - weights)),
t AS (SELECT source, source_size, least(coalesce(level, 'inf'::DOUBLE) * weight, 3.0::DOUBLE * source_size) AS target FROM s, l),
w AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix|', coalesce(doc_id::VARCHAR, ''))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN size > 0 AND (target - whole * source_size - own) / size + 0.5 >= 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM w
"""
