"""Size-tiered compaction of an append-only store of shards.

Arrivals are written once, each as a small immutable shard. Shards of similar
size, a tier, are merged in the order they came into files of a target size. A
snapshot is a manifest, a list of shards; each commit writes the next version
under its final name in one step, so readers see a version whole or not at all,
and of two writers one fails. Merging moves no row between tasks: each merged
file is read and written by one task, and a job has as many tasks as files.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import read_table, shared_dir

TARGET_BYTES = 128 << 20  # text bytes that a merged shard should hold
TIER_BASE = 1 << 20  # shards below this size are the lowest tier
TIER_FAN = 4  # sizes of a tier differ by less than this factor
LEAST_RUNS = 4  # shards of a tier that are worth merging
JOB_MERGES = 64  # merged files written by one job, each by a task of its own
#: Off while merging: a union would otherwise put inputs of one partition each into one task.
UNION = "spark.sql.unionOutputPartitioning"
ARRIVAL_ROWS = 4096  # ids of one arrival in the query


def tier(n_bytes: int) -> int:
    return max(0, math.ceil(math.log(max(n_bytes, 1) / TIER_BASE, TIER_FAN)))


def merges(shards: list[dict], target: int = TARGET_BYTES) -> list[list[dict]]:
    """Groups of shards to merge: of one tier, in order of arrival, at most ``target`` bytes together."""
    tiers: dict[int, list[dict]] = {}
    for s in sorted(shards, key=lambda s: s["order"]):
        if s["bytes"] < target / 2:
            tiers.setdefault(tier(s["bytes"]), []).append(s)
    out = []
    for _, runs in sorted(tiers.items()):
        if len(runs) < LEAST_RUNS:
            continue
        group: list[dict] = []
        for s in [*runs, None]:
            if group and (s is None or sum(x["bytes"] for x in group) + s["bytes"] > target):
                if len(group) > 1:
                    out.append(group)
                group = []
            if s:
                group.append(s)
    return out


class ShardStore:
    """Shards and versioned manifests under ``root``, a folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf) if "://" in self.root else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards: [{shard, order, rows, bytes}]}; empty for version 0."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: dict, schema: str, shards: list[dict]) -> dict:
        """The next version after ``base``; fails, changing nothing, if another writer has committed since."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["order"])}
        name = f"{self.root}/manifests/v{new['version']:08d}.json"
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(new).encode())
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self._rename, 1)
        options[0] = self._rename.NONE  # never over an existing file
        self._files.rename(draft, self._path(name), options)
        return new

    def _write(self, df: DataFrame, shard_col: str) -> list[dict]:
        """Write each value of ``shard_col`` as a shard; [{shard, rows, bytes}]."""
        batch = uuid.uuid4().hex
        df.write.option("compression", "zstd").partitionBy(shard_col).parquet(f"{self.root}/data/{batch}")
        own = F.col(shard_col)
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{batch}")
        size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string" and c != shard_col], F.lit(0))
        counted = back.groupBy(own.alias("shard")).agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes")).collect()  # one row a shard
        return [{"shard": f"{batch}/{shard_col}={r['shard']}", "value": r["shard"], "rows": r["rows"], "bytes": r["bytes"]} for r in counted]

    def _fresh(self, df: DataFrame) -> str:
        """A column name that ``df`` does not have in any case."""
        name, taken = "shard", {c.lower() for c in df.columns}
        while name in taken:
            name += "_"
        return name

    def append(self, df: DataFrame, arrival=None) -> dict:
        """Write ``df`` as new shards, one for each value of the long column ``arrival`` (or one in all), and commit."""
        base = self.manifest()
        name = self._fresh(df)
        found = self._write(df.withColumn(name, F.lit(0).cast("long") if arrival is None else arrival.cast("long")), name)
        first = max([-1, *(s["order"] for s in base["shards"])]) + 1
        new = [{"shard": s["shard"], "order": first + i, "rows": s["rows"], "bytes": s["bytes"]} for i, s in enumerate(sorted(found, key=lambda s: s["value"]))]
        return self.commit(base, df.schema.json(), base["shards"] + new)

    def _read(self, schema, shards: list[dict]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{s['shard']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot."""
        held = self.manifest(version)
        return self._read(self._schema(held), held["shards"])

    @staticmethod
    def _schema(held: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(held["schema"])) if held["schema"] else StructType()

    def read_by_shard(self, shard_col: str = "shard", tier_col: str = "tier") -> DataFrame:
        """The rows of the newest snapshot with their shard's order and tier."""
        held = self.manifest()
        rows = self._read(self._schema(held), held["shards"])
        if not held["shards"]:
            return rows.withColumn(shard_col, F.lit(0).cast("long")).withColumn(tier_col, F.lit(0))
        named = self.spark.createDataFrame([(s["shard"], s["order"], tier(s["bytes"])) for s in held["shards"]], f"_path string, `{shard_col}` long, `{tier_col}` int")
        own = rows.select("*", F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)/[^/]+$", 1).alias("_path"))
        return own.join(named, "_path").drop("_path")

    def _one_task_each(self, groups: list[list[dict]], shard_col: str) -> DataFrame:
        """The rows of each group, where ``UNION`` is off in a partition of its own, numbered in ``shard_col``."""
        schema = self._schema(self.manifest())
        return reduce(DataFrame.unionByName, [self._read(schema, g).coalesce(1).withColumn(shard_col, F.lit(i).cast("long")) for i, g in enumerate(groups)])

    def _merge(self, groups: list[list[dict]]) -> list[dict]:
        """Write each group as one shard in place of its parts."""
        name, batch = self._fresh(self._read(self._schema(self.manifest()), groups[0])), uuid.uuid4().hex
        before = self.spark.conf.get(UNION, "true")
        self.spark.conf.set(UNION, "false")
        try:
            self._one_task_each(groups, name).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/data/{batch}")
        finally:
            self.spark.conf.set(UNION, before)
        return [{"shard": f"{batch}/{name}={i}", "order": g[0]["order"], "rows": sum(s["rows"] for s in g), "bytes": sum(s["bytes"] for s in g)} for i, g in enumerate(groups)]

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merge until no tier has enough shards; the number of commits. Each round is one commit."""
        commits = 0
        while groups := merges((base := self.manifest())["shards"], target):
            new = [s for at in range(0, len(groups), JOB_MERGES) for s in self._merge(groups[at: at + JOB_MERGES])]
            gone = {s["shard"] for g in groups for s in g}
            self.commit(base, base["schema"], [s for s in base["shards"] if s["shard"] not in gone] + new)
            commits += 1
        return commits

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name; older snapshots can no longer be read."""
        live = {s["shard"] for s in self.manifest()["shards"]}
        for batch in self._fs.listStatus(self._path(f"{self.root}/data")):
            for shard in self._fs.listStatus(batch.getPath()):
                if shard.isDirectory() and f"{batch.getPath().getName()}/{shard.getPath().getName()}" not in live:
                    self._fs.delete(shard.getPath(), True)


def compacted(docs: DataFrame, arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET_BYTES) -> DataFrame:
    """Append ``docs`` by arrivals, compact, and read the newest snapshot.

    Per row: doc_id, shard (the order of the shard that holds it), tier,
    n_bytes and text_sha256 of what is stored. An arrival is a range of
    ``arrival_rows`` ids; rows without id are one more arrival. Nulls are kept
    (n_bytes and text_sha256 null); repeated rows stay repeated; an empty table
    gives no rows. All other columns are stored too, whatever their names.
    """
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/siltstone-shards-{uuid.uuid4().hex}"
    common._written.append(root)
    store = ShardStore(spark, root)
    if docs.isEmpty():
        store.commit(store.manifest(), docs.schema.json(), [])
    else:
        store.append(docs, F.coalesce(F.floor(F.col("doc_id") / arrival_rows), F.lit(-1)))
        store.compact(target)
        store.vacuum()
    name = store._fresh(docs)
    return store.read_by_shard(name, f"{name}_tier").select("doc_id", F.col(name).alias("shard"), F.col(f"{name}_tier").alias("tier"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(read_table(spark, sf_dir, "documents"))
