"""Quality rules, facets and summaries of a collection, each one aggregation over a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import ordered

FEW_VALUES = 4096  # distinct values of a key that one task sorts
BUCKETS = 1024  # spans of a histogram
LENGTH_BOUNDS = [0, 100, 200, 500, 1000, 2000, 4000]
FACET_VALUES = 15


def unpivoted(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) of every non-null value, as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("_p")).select("_p.field", "_p.value").where("value is not null")


def facets(df: DataFrame, fields: list[str], most: int = FACET_VALUES) -> DataFrame:
    """(field, value, n, place): the most frequent values of each field, ties by value."""
    counted = unpivoted(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def missing(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing)."""
    one = df.agg(F.count("*").alias("n"), *[F.count(f).alias(f"p{i}") for i, f in enumerate(fields)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), (F.col("n") - F.col(f"p{i}")).alias("missing")) for i, f in enumerate(fields)])).alias("r")).select("r.*")


def months(df: DataFrame, date: str) -> DataFrame:
    """(month, n) of a date's text."""
    return df.select(V.month_key(F.col(date).cast("string")).alias("month")).where("month is not null").groupBy("month").agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, text: str = "document", bounds: list[int] = LENGTH_BOUNDS) -> DataFrame:
    """(low, n) for each bucket, empty ones too: lengths from ``low`` up to the next bound."""
    n = F.length(text)
    low = F.lit(bounds[0])
    for b in bounds[1:]:
        low = F.when(n >= b, F.lit(b)).otherwise(low)
    counted = df.where(F.col(text).isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, bounds))).alias("low"))
    return every.join(counted, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))


def upper_median(values: DataFrame, column: str, keys: list[str] = (), few: int = FEW_VALUES) -> DataFrame:
    """(keys, median): of n sorted values the one at n div 2; found by histograms, so no task sorts a key's values.

    Each pass counts the values of a key in ``BUCKETS`` equal spans and goes on
    within the span that holds the median, until at most ``few`` distinct values
    are left there. Values are numbers; equal ones are counted once before.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ordered.with_checkpoints(values.sparkSession)
    counted = counted.checkpoint()
    kinds = [F.sum("_n").alias("_n"), F.count("*").alias("_distinct"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    left = counted.groupBy(*keys).agg(*kinds).select(*keys, F.floor(F.col("_n") / 2).alias("_rank"), "_distinct", "_low", "_high").checkpoint()

    def within(spans: DataFrame) -> DataFrame:
        """The values between the ends of their key's span."""
        named = spans.select(*(F.col(k).alias(f"_{k}") for k in keys), "_rank", "_low", "_high")
        on = F.col("_v").between(F.col("_low"), F.col("_high"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return counted.join(named if keys else F.broadcast(named), on).drop(*(f"_{k}" for k in keys))  # without keys it is one row

    done = left.where(F.col("_distinct") <= few)
    wide = left.where(F.col("_distinct") > few)
    while not wide.isEmpty():
        v, low, high = (F.col(c).cast("double") / 2 for c in ("_v", "_low", "_high"))
        bucket = F.least(F.floor((v - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        spans = within(wide).groupBy(*keys, "_rank", bucket.alias("_bucket")).agg(*kinds)
        upto = F.sum("_n").over(own.orderBy("_bucket"))  # at most BUCKETS rows
        spans = spans.withColumn("_before", upto - F.col("_n")).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        spans = spans.select(*keys, (F.col("_rank") - F.col("_before")).alias("_rank"), "_distinct", "_low", "_high").checkpoint()
        done = done.unionByName(spans.where(F.col("_distinct") <= few))
        wide = spans.where(F.col("_distinct") > few)
    last = within(done).withColumn("_upto", F.sum("_n").over(own.orderBy("_v")))  # at most ``few`` rows
    return last.where(F.col("_upto") > F.col("_rank")).groupBy(*keys).agg(F.min("_v").alias("median"))


def _by_text(df: DataFrame, text: str, *more: str) -> DataFrame:
    return df.where(F.trim(text) != "").select(F.sha2(F.trim(text), 256).alias("text_hash"), "id", *more)


def _groups(df: DataFrame, text: str, *more: Column) -> DataFrame:
    return _by_text(df, text).groupBy("text_hash").agg(F.count("*").alias("n"), *more).where("n > 1")


def duplicates(df: DataFrame, text: str = "document", files: str | None = None) -> DataFrame:
    """(text_hash, n, ids, files): groups of equal texts (ends trimmed), empty ones aside, with all their ids in order; the first 3 files are named.

    A group may hold any share of the rows: of its rows only ids are gathered.
    ``duplicate_members`` gives the same members a row each.
    """
    groups = _groups(df, text, F.array_sort(F.collect_list("id")).alias("ids"))
    if not files:
        return groups.withColumn("files", F.array().cast("array<string>"))
    each = _by_text(df, text, F.col(files).cast("string").alias("file")).where("file is not null").groupBy("text_hash", "file").agg(F.lit(1).alias("_one"))
    place = F.row_number().over(W.partitionBy("text_hash").orderBy("file"))
    named = each.withColumn("_n", place).where("_n <= 3").groupBy("text_hash").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return groups.join(named, "text_hash", "left").select("text_hash", "n", "ids", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def duplicate_members(df: DataFrame, text: str = "document") -> DataFrame:
    """(id, text_hash, n): every row whose text others have too, with its group. Hashes alone are joined, a large group's by Spark's skew join."""
    return _by_text(df, text).join(_groups(df, text), "text_hash").select("id", "text_hash", "n")


def chunk_gaps(chunks: DataFrame, file: str = "file", index: str = "chunk_index") -> DataFrame:
    """(file, missing): indices that lack between 0 and the file's largest. Runs, not arrays, are compared."""
    own = W.partitionBy(file).orderBy(index)
    step = chunks.where(F.col(index).isNotNull()).select(file, index).distinct().withColumn("_before", F.coalesce(F.lag(index).over(own), F.lit(-1)))
    holes = step.where(F.col(index) - F.col("_before") > 1)
    return holes.select(file, F.explode(F.sequence(F.col("_before") + 1, F.col(index) - 1)).alias("missing"))


def row_problems(df: DataFrame, text: Column, fields: list[str], embedding: str | None = None, dim: int | None = None) -> DataFrame:
    """(id, category) of the row rules: empty, wordless, no_metadata, no_vector, dimension."""
    rules = [(F.coalesce(F.trim(text), F.lit("")) == "", "empty"), ((F.trim(text) != "") & ~T.has_word(text), "wordless")]
    nothing = F.lit(True)
    for f in fields:
        nothing = nothing & F.col(f).isNull()
    rules.append((nothing, "no_metadata"))
    if embedding:
        rules.append((F.col(embedding).isNull(), "no_vector"))
        rules.append((F.size(embedding) != dim, "dimension"))
    found = F.array_compact(F.array(*[F.when(r, F.lit(c)) for r, c in rules]))
    return df.select("id", F.explode(found).alias("category"))


def superseded(chunks: DataFrame, parent: str = "parent_id", run: str = "run") -> DataFrame:
    """(id, parent): pieces from another run than their parent's."""
    p = chunks.select(F.col("id").alias(parent), F.col(run).alias("_run"))
    return chunks.join(p, parent).where(~F.col(run).eqNullSafe(F.col("_run"))).select("id", parent)


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, before, after): findings by category in two reports."""
    a = before.groupBy("category").agg(F.count("*").alias("before"))
    b = after.groupBy("category").agg(F.count("*").alias("after"))
    return a.join(b, "category", "full").select("category", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def mentions(df: DataFrame, term: str, file: str = "file", index: str = "chunk_index", page: int = 20, samples: int = 3) -> DataFrame:
    """(file, hits, place, samples): files by how many chunks mention a term in any usual spelling."""
    matched = df.where(T.contains_any(F.col("document"), T.case_variants(term)))
    files = matched.groupBy(file).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), file).limit(page)
    files = files.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("hits"), file)))
    few = matched.withColumn("_n", F.row_number().over(W.partitionBy(file).orderBy(F.col(index).asc_nulls_last(), "id"))).where(F.col("_n") <= samples)
    return files.join(few.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_s")), file).select(file, "hits", "place", F.transform("_s", lambda x: x["id"]).alias("samples"))


def inferred_schema(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, type, required, present) of text fields: one observed type or string, required if never missing."""
    total = df.count()
    kinds = unpivoted(df, fields).select("field", V.inferred_kind(F.col("value")).alias("kind"))
    agg = kinds.groupBy("field").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("present"))
    numeric = F.array_sort("kinds") == F.array(F.lit("integer"), F.lit("number"))
    kind = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(numeric, "number").otherwise("string")
    return agg.select("field", kind.alias("type"), (F.col("present") == total).alias("required"), "present")


def violations(df: DataFrame, schema: list[tuple[str, str, bool]], extra_fields: list[str] = (), allow_extra: bool = True) -> DataFrame:
    """(id, field, violation): missing_required, wrong_type, unexpected_field; ``schema`` lists (field, type, required)."""
    checks = []
    for name, kind, required in schema:
        v = F.col(name).cast("string")
        wrong = v.isNotNull() & ~V.accepts(V.inferred_kind(v), F.lit(kind)) if kind != "string" else F.lit(False)
        if kind == "date":
            wrong = v.isNotNull() & V.as_date_text(v).isNull()
        what = F.when(v.isNull() & F.lit(required), "missing_required").when(wrong, "wrong_type")
        checks.append(F.struct(F.lit(name).alias("field"), what.alias("violation")))
    if not allow_extra:
        checks += [F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), "unexpected_field").alias("violation")) for f in extra_fields]
    return df.select("id", F.explode(F.array(*checks)).alias("c")).select("id", "c.field", "c.violation").where("violation is not null")


def field_summary(df: DataFrame, fields: list[str], examples: int = 5) -> DataFrame:
    """(field, type, examples): observed type, mixed on conflict, and the first distinct values."""
    kinds = unpivoted(df, fields).where("value != ''").select("field", "value", V.inferred_kind(F.col("value")).alias("kind"))
    types = kinds.groupBy("field").agg(F.when(F.count_distinct("kind") == 1, F.min("kind")).otherwise("mixed").alias("type"))
    few = kinds.select("field", "value").distinct().withColumn("n", F.row_number().over(W.partitionBy("field").orderBy("value"))).where(F.col("n") <= examples)
    return types.join(few.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("examples")), "field")


def keywords(df: DataFrame, stop_words: list[str], most: int = 8) -> DataFrame:
    """(id, word, n, place): each text's most frequent words, ties by first use."""
    words = F.filter(F.split(F.lower("document"), r"[^\p{L}]+"), lambda w: (F.length(w) > 2) & ~w.isin(stop_words))
    each = df.select("id", F.posexplode(words).alias("at", "word"))
    counted = each.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select("id", "word", "n", "place")


def folder_levels(paths: DataFrame, path: str = "path") -> DataFrame:
    """(level, folders, files, first): distinct folder names at each depth, files at it or below, and the first by name."""
    parts = F.split(path, "/")
    each = paths.select(F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("level", "folder"))
    return each.groupBy("level").agg(F.count_distinct("folder").alias("folders"), F.count("*").alias("files"), F.min("folder").alias("first"))


def substituted(chunks: DataFrame, note: str = "chunk_note", file: str = "file") -> DataFrame:
    """(file, notes): files that were cut by another strategy than asked for, with the distinct notes."""
    own = F.coalesce(F.col(file), F.col("id").cast("string"))
    return chunks.where(F.col(note).isNotNull()).groupBy(own.alias("file")).agg(F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"))


def gone_from_disk(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Chunks whose file is not among ``listing`` (source, file), of sources that could be listed."""
    known = listing.select("source").distinct()
    return chunks.where(F.col("file").isNotNull()).join(known, "source", "left_semi").join(listing.select("source", "file"), ["source", "file"], "left_anti")
