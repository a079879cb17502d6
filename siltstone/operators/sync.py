"""Change detection for files, table rows and pages, each as one join and a status column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V

MTIME_TOLERANCE = 1.0  # seconds
GUARD_LEAST, GUARD_SHARE = 10, 0.5


def file_plan(files: DataFrame, manifest: DataFrame, recipe: str | None = None) -> DataFrame:
    """(path, status, reason): new, changed, touched, unchanged, missing for files against a manifest.

    ``files``: path, size, mtime (seconds), content_hash; ``manifest`` the same
    with recipe. Same size and time (one second apart at most) need no reading;
    else equal content only moves the stamp. A recipe that changed means the file
    must be cut anew.
    """
    old = manifest.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "content_hash", "recipe")])
    both = files.withColumn("_here", F.lit(True)).join(old.withColumn("_known", F.lit(True)), "path", "full")
    same_stat = (F.col("size") == F.col("old_size")) & (F.abs(F.col("mtime") - F.col("old_mtime")) <= MTIME_TOLERANCE)
    same_text = F.col("content_hash").eqNullSafe(F.col("old_content_hash"))
    other_recipe = F.lit(False) if recipe is None else ~F.col("old_recipe").eqNullSafe(F.lit(recipe))
    status = (
        F.when(F.col("_here").isNull(), "missing").when(F.col("_known").isNull(), "new")
        .when(other_recipe, "changed").when(same_stat, "unchanged").when(same_text, "touched").otherwise("changed")
    )
    reason = F.when(status != "changed", None).when(other_recipe, "recipe").otherwise("content")
    return both.select("path", status.alias("status"), reason.alias("reason"))


def mass_disappearance(plan: DataFrame) -> DataFrame:
    """(known, missing, suspicious): at least ten and half of the known files gone at once."""
    one = plan.agg(F.count_if(F.col("status") != "new").alias("known"), F.count_if(F.col("status") == "missing").alias("missing"))
    return one.withColumn("suspicious", (F.col("missing") >= GUARD_LEAST) & (F.col("missing") >= GUARD_SHARE * F.col("known")))


def needs_confirmation(plan: DataFrame, files: int = 100) -> DataFrame:
    one = plan.agg(F.count_if(F.col("status").isin("new", "changed")).alias("to_write"))
    return one.withColumn("confirm", F.col("to_write") > files)


def route(path: Column, rule: str, name: str = "main", pattern: str = "", template: str = "$1", fallback: str = "main") -> Column:
    """The collection of a file: single, folder (first part), subfolder (second) or a regex with a template."""
    parts = F.split(path, "/")
    if rule == "single":
        return F.lit(name)
    if rule in ("folder", "subfolder"):
        at = 1 if rule == "folder" else 2
        return collection_name(F.when(F.size(parts) > at, F.element_at(parts, at)).otherwise(F.lit(fallback)))
    return collection_name(F.when(path.rlike(pattern), F.regexp_replace(F.regexp_extract(path, pattern, 0), pattern, template)).otherwise(F.lit(fallback)))


def collection_name(name: Column) -> Column:
    """A legal collection name: letters, digits, dot, dash and underscore, 3 to 63 of them, alphanumeric at the ends."""
    clean = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    cut = F.regexp_replace(F.substring(clean, 1, 63), r"[^A-Za-z0-9]+$", "")
    return F.when(F.length(cut) >= 3, cut).otherwise(F.concat(cut, F.substring(F.lit("col"), 1, 3)))


def path_level(path: Column, level: int, fallback: str | None = None) -> Column:
    """The name of a file's n-th folder (from 1)."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > level, F.element_at(parts, level)).otherwise(F.lit(fallback))


def journal_state(journal: DataFrame) -> DataFrame:
    """(path, state): the last state of each path by sequence number."""
    return journal.groupBy("path").agg(F.max_by("state", "seq").alias("state"))


def unfinished(journal: DataFrame) -> DataFrame:
    return journal_state(journal).where("state != 'done'")


def removals(plan: DataFrame, policy: str) -> DataFrame:
    """(path, action) of missing files: delete, keep (marked orphaned) or postpone."""
    return plan.where("status = 'missing'").select("path", F.lit({"delete": "delete", "keep": "orphan"}.get(policy, "postpone")).alias("action"))


def metadata_refresh(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(id, set, removed): rows whose metadata changed: what to set, and which keys went."""
    o = old.select("id", *[F.col(k).cast("string").alias(f"o_{k}") for k in keys])
    j = o.join(new.select("id", *[F.col(k).cast("string").alias(k) for k in keys]), "id")
    changed = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value"), F.col(f"o_{k}").alias("old")) for k in keys]), lambda x: ~x["value"].eqNullSafe(x["old"]))
    out = j.select("id", changed.alias("c")).where(F.size("c") > 0)
    put = F.filter("c", lambda x: x["value"].isNotNull())
    return out.select("id", F.map_from_arrays(F.transform(put, lambda x: x["key"]), F.transform(put, lambda x: x["value"])).alias("set"), F.transform(F.filter("c", lambda x: x["value"].isNull()), lambda x: x["key"]).alias("removed"))


def renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows (path, chunk_index, …) of renamed files (old_path, new_path) under their new path and id; vectors move along."""
    r = renames.select(F.col("old_path").alias("path"), "new_path")
    moved = rows.join(r, "path").withColumn("path", F.col("new_path")).drop("new_path")
    return moved.withColumn("id", chunk_id(F.col("path"), F.col("chunk_index")))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(F.substring(F.sha2(path, 256), 1, 16), F.lit("-"), index.cast("string"))


def row_diff(fresh: DataFrame, manifest: DataFrame) -> DataFrame:
    """Table rows against the last run's: added, re_embedded, metadata_only, unchanged, disappeared, duplicate.

    ``fresh`` and ``manifest``: row_number, row_key (or null), text_hash,
    metadata_hash. Rows with a key are recognised by it, the first row of each;
    others by content, the n-th of equal texts by the n-th, so that an inserted
    row changes nothing else.
    """
    def identified(df):
        keyed = F.col("row_key").isNotNull()
        name = F.when(keyed, F.concat(F.lit("key\0"), F.col("row_key"))).otherwise(F.concat(F.lit("text\0"), F.col("text_hash")))
        n = F.row_number().over(W.partitionBy("_name").orderBy("row_number"))
        return df.withColumn("_name", name).withColumn("_n", n).withColumn("_dup", keyed & (F.col("_n") > 1))

    f, m = identified(fresh), identified(manifest).where(~F.col("_dup"))
    old = m.select("_name", "_n", F.col("row_number").alias("old_row"), F.col("text_hash").alias("old_text"), F.col("metadata_hash").alias("old_meta"))
    dups = f.where("_dup").select("row_number", F.lit(None).cast("long").alias("old_row"), F.lit("duplicate").alias("status"))
    j = f.where("not _dup").join(old.hint("shuffle_merge"), ["_name", "_n"], "full")  # neither side is small
    status = (
        F.when(F.col("row_number").isNull(), "disappeared").when(F.col("old_row").isNull(), "added")
        .when(F.col("text_hash") != F.col("old_text"), "re_embedded").when(~F.col("metadata_hash").eqNullSafe(F.col("old_meta")), "metadata_only").otherwise("unchanged")
    )
    return j.select("row_number", F.col("old_row").cast("long").alias("old_row"), status.alias("status")).unionByName(dups)


def schema_coverage(required: list[str], provided: list[str], defaults: dict[str, object] | None = None) -> list[str]:
    """Required fields that nothing guarantees."""
    return [f for f in required if f not in provided and not (defaults or {}).get(f)]


def source_chunks(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose file is no longer listed."""
    return chunks.join(paths.select("path"), "path", "left_anti")


def due(sources: DataFrame, now: Column, started: Column, settle: int = 5) -> DataFrame:
    """(source, reason): which sources should be synchronised now, and by which trigger.

    ``sources``: source, paused, running, last_run, on_launch, every, hour,
    minute, weekday, changed_at. A paused source, or one that is running, never
    is due. The launch counts before the schedule, the schedule before a change
    of files, which must have been left alone for ``settle`` seconds.
    """
    ran = F.col("last_run")
    launch = F.col("on_launch") & (ran.isNull() | (ran < started))
    schedule = V.next_fire(F.coalesce(ran, F.lit("1970-01-01").cast("timestamp_ntz")), F.col("every"), F.col("hour"), F.col("minute"), F.col("weekday")) <= now
    changed = (ran.isNull() | (F.col("changed_at") > ran)) & (F.col("changed_at") <= now - F.make_dt_interval(secs=F.lit(settle)))
    reason = F.when(launch, "launch").when(schedule, "schedule").when(changed, "watch")
    free = ~F.coalesce(F.col("paused"), F.lit(False)) & ~F.coalesce(F.col("running"), F.lit(False))
    return sources.where(free).select("source", reason.alias("reason")).where("reason is not null")
