"""Export packages (documents.jsonl parts and a manifest), imports with a conflict policy, trash and audit exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, document string, metadata map<string,string>, embedding array<double>, _broken string"


def export_collection(rows: DataFrame, path: str, about: dict | None = None, where=None) -> dict:
    """Write ``rows`` as JSON lines below ``path`` with a manifest; the manifest.

    The digest is over the rows' own digests, summed, so it does not depend on
    how rows are spread over files.
    """
    rows = rows if where is None else rows.where(where)
    lines = rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/documents.jsonl")
    n, size, digest = digest_of(rows.sparkSession.read.text(f"{path}/documents.jsonl"))
    manifest = {**(about or {}), "documents": n, "bytes": size, "digest": digest}
    rows.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def read_package(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The manifest, and records with ``_broken`` set for lines that are no record."""
    manifest = json.loads(spark.read.text(f"{path}/manifest.json").first()[0])
    rows = spark.read.schema(RECORD).json(f"{path}/documents.jsonl", mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    return manifest, rows


def compatible(manifest: dict, collection: dict) -> list[str]:
    """What keeps a package from being imported into a collection."""
    return [f"{k}: {manifest[k]} and {collection[k]}" for k in ("dimension", "metric", "model") if manifest.get(k) and collection.get(k) and manifest[k] != collection[k]]


def import_plan(records: DataFrame, existing: DataFrame, policy: str) -> DataFrame:
    """``records`` with action: write, overwrite, skip, stop or broken, by what is there and the policy skip, overwrite or stop."""
    known = existing.select("id").distinct().withColumn("_known", F.lit(True))
    broken = F.col("_broken").isNotNull() | F.col("id").isNull() if "_broken" in records.columns else F.col("id").isNull()
    clash = {"skip": "skip", "overwrite": "overwrite", "stop": "stop"}[policy]
    return records.join(known, "id", "left").withColumn("action", F.when(broken, "broken").when(F.col("_known"), clash).otherwise("write")).drop("_known")


def digest_of(lines: DataFrame) -> tuple[int, int, str]:
    """(lines, bytes, digest) of rows (value): the digests of the lines, summed."""
    half = F.conv(F.substring(F.sha2("value", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    n, size, digest = lines.agg(F.count("*"), F.sum(F.octet_length("value") + 1), F.sum(half)).first()
    return n, size or 0, str(digest or 0)


def import_package(catalog, name: str, path: str, policy: str = "skip", embed=None, files_a_batch: int = 16) -> dict:
    """Bring a package into a collection of ``catalog``; run again after a failure it goes on where it stopped.

    The package's files are a stream. Each batch is parsed, given the vectors it
    lacks by ``embed``, and stored under its number, so a batch that is done
    again replaces itself, and batches committed before are neither read nor
    embedded again. When all are there the collection is changed once. An import
    that was finished before changes nothing. Returns what came of the records:
    written, overwritten, skipped, broken. A package that is not what its
    manifest says, or does not fit the collection, is refused; so is, with the
    policy stop, one with ids that are there already.
    """
    from ..operators.embedding import embedded

    spark = catalog.spark
    manifest, _ = read_package(spark, path)
    if (found := digest_of(spark.read.text(f"{path}/documents.jsonl"))) != (manifest["documents"], manifest["bytes"], manifest["digest"]):
        raise ValueError(f"the package holds {found[0]} lines of {found[1]} bytes that its manifest does not know")
    collection = catalog.get(name)
    if wrong := compatible(manifest, {"metric": collection.metric, "dimension": collection.dimension}):
        raise ValueError("; ".join(wrong))
    staged = f"{catalog.root}/imports/{name}-{policy}-{manifest['digest'][:32]}"
    done = f"{staged}/done"
    if catalog.holds(done):
        return json.loads(spark.read.text(done).first()[0])

    def store(batch: DataFrame, number: int) -> None:
        rows = batch
        if embed is not None:
            lacking = F.col("embedding").isNull() & F.col("document").isNotNull()
            asked = embedded(rows.where(lacking), embed).select(rows.columns)
            rows = rows.where(~F.coalesce(lacking, F.lit(False))).unionByName(asked)
        rows.write.mode("overwrite").parquet(f"{staged}/rows/batch={number}")

    stream = spark.readStream.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files_a_batch).json(f"{path}/documents.jsonl")
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{staged}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    counts = {"written": 0, "overwritten": 0, "skipped": 0, "broken": 0}
    if catalog.holds(f"{staged}/rows"):
        rows = spark.read.parquet(f"{staged}/rows").drop("batch")
        there = catalog.read(name) if catalog.holds(collection.path) else rows.limit(0)
        plan = import_plan(rows, there, policy)
        if plan.where("action = 'stop'").limit(1).count():
            raise ValueError("the collection holds records of the package")
        found = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        counts = {"written": found.get("write", 0), "overwritten": found.get("overwrite", 0), "skipped": found.get("skip", 0), "broken": found.get("broken", 0)}
        # told before the change, as after it every record is there already
        told = f"{staged}/told"
        if catalog.holds(told):
            counts = json.loads(spark.read.text(told).first()[0])
        else:
            catalog.put(told, json.dumps(counts))
        catalog.upsert(name, plan.where(F.col("action").isin("write", "overwrite")).drop("action", "_broken"))
    catalog.put(done, json.dumps(counts))
    for part in ("rows", "checkpoint", "told"):
        catalog.remove(f"{staged}/{part}")
    return counts


def to_trash(rows: DataFrame, collection: str, at) -> DataFrame:
    """Rows as trash entries: everything that a restore needs."""
    return rows.select(F.lit(collection).alias("collection"), F.lit(at).alias("deleted_at"), "*")


def restore_plan(trash: DataFrame, text: str = "document", vector: str = "embedding") -> DataFrame:
    """(collection, restorable, skipped): entries without text or vector cannot go back."""
    good = F.col(text).isNotNull() & F.col(vector).isNotNull()
    return trash.groupBy("collection").agg(F.count_if(good).alias("restorable"), F.count_if(~good).alias("skipped"))


def csv_line(*columns: str):
    """One CSV record, quoted where needed, as a Column."""
    def cell(c):
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return F.concat_ws(",", *map(cell, columns))


def markdown_report(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda r: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), "|" + " --- |" * len(df.columns), *map(line, rows)])
