"""Collections as Parquet tables in a folder, with a catalog of their properties.

Rows are id, document, embedding and typed metadata columns. Writers produce a
new version beside the old one and switch the catalog entry last, so a failed
job leaves the collection as it was.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered

METRICS = ("cosine", "l2", "ip")


@dataclass
class Collection:
    name: str
    path: str
    metric: str = "cosine"
    dimension: int | None = None
    metadata: dict | None = None


class Catalog:
    """Collections below ``root``, any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, name: str) -> str:
        return f"{self.root}/catalog/{name}.json"

    def holds(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def put(self, path: str, text: str) -> None:
        """Write a small file of the catalog."""
        if self.read_only:
            raise PermissionError("the catalog is read-only")
        out = self._fs.create(self._path(path), True)
        out.write(text.encode())
        out.close()

    def remove(self, path: str) -> None:
        if self.read_only:
            raise PermissionError("the catalog is read-only")
        self._fs.delete(self._path(path), True)

    def _save(self, c: Collection) -> None:
        self.put(self._entry(c.name), json.dumps(c.__dict__))

    def create(self, name: str, metric: str = "cosine", metadata: dict | None = None, get_or_create: bool = False) -> Collection:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        if self._fs.exists(self._path(self._entry(name))):
            if get_or_create:
                return self.get(name)
            raise ValueError(f"{name} exists")
        c = Collection(name, f"{self.root}/data/{uuid.uuid4().hex}", metric, None, metadata or {})
        self._save(c)
        return c

    def get(self, name: str) -> Collection:
        path = self._path(self._entry(name))
        if not self._fs.exists(path):
            raise KeyError(name)
        stream = self._fs.open(path)
        try:
            return Collection(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        folder = self._path(f"{self.root}/catalog")
        return sorted(s.getPath().getName()[:-5] for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def update(self, name: str, metadata: dict) -> Collection:
        c = self.get(name)
        c.metadata = {**(c.metadata or {}), **metadata}
        self._save(c)
        return c

    def drop(self, name: str) -> None:
        if self.read_only:
            raise PermissionError("the catalog is read-only")
        c = self.get(name)
        self._fs.delete(self._path(self._entry(name)), False)
        self._fs.delete(self._path(c.path), True)

    def reset(self) -> None:
        for name in self.names():
            self.drop(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.get(name).path)

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a collection's rows; the old ones go only after the new stand."""
        c = self.get(name)
        new, old = f"{self.root}/data/{uuid.uuid4().hex}", c.path
        rows.write.parquet(new)
        c.path = new
        self._save(c)
        self._fs.delete(self._path(old), True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        c = self.get(name)
        self.write(name, upserted(self.read(name), rows) if self._fs.exists(self._path(c.path)) else last_of_each(rows))

    def delete(self, name: str, ids: DataFrame | None = None, where=None) -> None:
        """Rows by id, or by a predicate, which must be given on purpose."""
        if ids is None and where is None:
            raise ValueError("what should be deleted?")
        rows = self.read(name)
        self.write(name, deleted(rows, ids) if ids is not None else rows.where(~F.coalesce(where, F.lit(False))))


def page(rows: DataFrame, limit: int = 100, offset: int = 0, columns: list[str] | None = None, where=None) -> DataFrame:
    """Rows in order of id, from ``offset``; the limit is pushed into the sort."""
    out = rows if where is None else rows.where(where)
    out = out.select(columns) if columns else out
    return out.orderBy("id").offset(offset).limit(limit)


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def existing_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(rows.select("id"), "id", "left_semi")


def any_matching(rows: DataFrame, where) -> DataFrame:
    """One row: whether a row matches."""
    return rows.where(where).limit(1).agg((F.count("*") > 0).alias("found"))


def dimension(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("dimension")).limit(1)


def last_of_each(rows: DataFrame) -> DataFrame:
    """One row an id; of repeated ones an arbitrary but stable one."""
    order = F.xxhash64(*(F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in rows.dtypes))  # maps have no hash
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    new = last_of_each(new)
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def updated(old: DataFrame, changes: DataFrame, removed: str | None = None) -> DataFrame:
    """``old`` with the non-null values of ``changes`` (id, …); columns named in the array ``removed`` become null."""
    put = [c for c in changes.columns if c in old.columns and c not in ("id", removed)]
    c = changes.select("id", *[F.col(x).alias(f"_new_{x}") for x in put], *([F.col(removed).alias("_gone")] if removed else []))
    joined = old.join(c, "id", "left")
    out = []
    for x in old.columns:
        v = F.coalesce(f"_new_{x}", x) if x in put else F.col(x)
        if removed and x != "id":
            v = F.when(~F.coalesce(F.array_contains("_gone", F.lit(x)), F.lit(False)), v)
        out.append(v.alias(x))
    return joined.select(out)


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def missing_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(rows.select("id"), "id", "left_anti")


def json_bytes(text):
    """Bytes of a text as a JSON string: quotes and backslashes take two, control characters six."""
    own = F.coalesce(text, F.lit(""))
    doubled = F.octet_length(own) - F.octet_length(F.regexp_replace(own, r'["\\]', ""))
    control = F.octet_length(own) - F.octet_length(F.regexp_replace(own, r"[\x00-\x1F]", ""))
    return F.octet_length(own) + 2 + doubled + 5 * control


def record_bytes(id_col, document, numbers, metadata: dict | None = None):
    """About the bytes of a record on the wire: ``numbers`` is the vector's length, ``metadata`` columns by key."""
    out = json_bytes(id_col.cast("string")) + 1 + json_bytes(document) + 1 + F.coalesce(numbers, F.lit(0)) * 25 + 2 + 2
    for key, value in (metadata or {}).items():
        out = out + len(key.encode()) + 4 + F.when(value.isNull(), 4).otherwise(json_bytes(value.cast("string")))
    return out.cast("long")


class Filling(ordered.Fold):
    """Batches filled one after the other: the state is (batches opened, rows and bytes in the open one).

    A stretch is noted by where its first new batch may open. Each of these
    places leads to a chain of batches, and chains from neighbouring places soon
    run together, so places that end alike are noted once: (place, bytes before
    it, batches opened, rows and bytes in the last). The last entry is the end
    of the stretch, for a batch that takes it whole.
    """

    start = (0, 0, 0)
    adds = "batch long"

    def __init__(self, most_rows: int, most_bytes: int, envelope: int):
        self.most_rows, self.room = most_rows, most_bytes - envelope

    def _sizes(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """(which rows fit a batch, bytes before each of those and at the end)."""
        sizes = batch.column(0).to_numpy(zero_copy_only=False)
        fits = sizes <= self.room
        return fits, np.concatenate([[0], np.cumsum(sizes[fits])]).astype(np.int64)

    def _next(self, before: np.ndarray) -> np.ndarray:
        """For a batch opened at each row, the first row that it cannot take."""
        at = np.arange(len(before) - 1)
        return np.minimum(np.searchsorted(before, before[:-1] + self.room, "right") - 1, np.minimum(at + self.most_rows, len(at)))

    def note(self, batch) -> list[tuple]:
        _, before = self._sizes(batch)
        m, out = len(before) - 1, []
        if m:
            follow = self._next(before).tolist()
            opened, last = [0] * m, [0] * m
            for i in range(m - 1, -1, -1):
                j = follow[i]
                opened[i], last[i] = (1, i) if j == m else (opened[j] + 1, last[j])
            for c in range(min(follow[0], m - 1) + 1):
                if not out or (opened[c], m - last[c]) != out[-1][2:4]:
                    out.append((c, int(before[c]), opened[c], m - last[c], int(before[m] - before[last[c]])))
        return [*out, (m, int(before[m]), 0, 0, 0)]

    def after(self, note: list[tuple], state: tuple) -> tuple:
        opened, n, used = state
        c = len(note) - 1
        if not opened:
            c = 0
        while c and (n + note[c][0] > self.most_rows or used + note[c][1] > self.room):
            c -= 1
        place, size, more, rows, left = note[c]
        return (opened + more, rows, left) if more else (opened, n + place, used + size)

    def then(self, note: list[tuple], later: list[tuple]) -> list[tuple]:
        out = []
        for place, size, more, rows, left in note[:-1]:
            out.append((place, size, *self.after(later, (more, rows, left))))
        place, size = note[-1][:2]
        out += [(place + c, size + s, *end) for c, s, *end in later]
        whole, kept = out.pop(), []
        for entry in out:
            if not kept or kept[-1][2:] != entry[2:]:
                kept.append(entry)
        return [*kept, whole]

    def apply(self, batch, state: tuple):
        import pyarrow as pa

        fits, before = self._sizes(batch)
        m, (opened, n, used) = len(before) - 1, state
        c = min(int(np.searchsorted(before, self.room - used, "right")) - 1, self.most_rows - n, m) if opened else 0
        places, follow = [], self._next(before).tolist()
        while c < m:
            places.append(c)
            c = follow[c]
        number = np.full(len(fits), -1, np.int64)
        number[fits] = opened - 1 + np.searchsorted(places, np.arange(m), "right")
        state = (opened + len(places), m - places[-1], int(before[m] - before[places[-1]])) if places else (opened, n + m, used + int(before[m]))
        return state, [pa.array(number, pa.int64(), mask=~fits)]


def batches(rows: DataFrame, most_rows: int, most_bytes: int, size, order: str | None = "id", envelope: int = 128, parts: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: no batch has more rows than allowed or, with its envelope, more bytes.

    Rows are taken in the order of a column, or as they come where ``order`` is
    None, and open a new batch where they no longer fit, counted from 0 on; a
    row too large for any batch gets none (null). Batches go on from one part of
    the scan to the next, so the order alone decides, not how rows are dealt.
    """
    keyed = rows.withColumn("_size", size.cast("long"))
    return ordered.scan(keyed, [F.col(order)] if order else [], Filling(most_rows, most_bytes, envelope), ["_size"], parts=parts).drop("_size")


def keep_newest(rows: DataFrame, at: str, size: str, most_bytes: int, oldest=None, keys: list[str] = (), parts: int | None = None) -> DataFrame:
    """Retention: rows from ``oldest`` on, newest first until the bytes are used up, by ``keys`` if given.

    Sums run along the order part by part; rows of one time are told apart by
    id, so neither a busy moment nor a large key falls to one task.
    """
    out = rows if oldest is None else rows.where(F.col(at) >= oldest)
    summed = ordered.running(out, [F.col(at).desc(), F.col("id")], {"_before": F.col(size)}, parts, list(keys))
    return summed.where(F.col("_before") + F.col(size) <= most_bytes).select(*rows.columns)


def file_chunks(chunks: DataFrame, file: str | None = None, file_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A file's chunks by its fingerprint or, without one, its path in any spelling of marks, in order; chunks without an index last."""
    if file_id is not None:
        own = chunks.where(F.col("file_id") == file_id)
    else:
        own = chunks.where(F.col("file").isin(sorted({unicodedata.normalize(form, file or "") for form in ("NFC", "NFD")} | {file or ""})))
    return own.orderBy(F.col("chunk_index").asc_nulls_last(), "id").offset(offset).limit(limit)


def in_file_order(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """``chunks`` with ``place``, from 0 on in their file, in order of index and id, chunks without an index last; a file may fill many parts."""
    one = F.lit(1).cast("long")
    return ordered.running(chunks, [F.col("chunk_index").asc_nulls_last(), F.col("id")], {"place": one}, parts, ["file"])


def similar_files(chunks: DataFrame, path: str, most: int = 5) -> DataFrame:
    """(file, n): files whose name, case and marks aside, is that of ``path``, or holds it; what to offer where a path was not found."""
    name = T.fold_word(path.rsplit("/", 1)[-1])
    own = T.unmarked(F.regexp_extract("file", r"[^/]*$", 0))
    found = chunks.where(own.contains(name)).groupBy("file").agg(F.count("*").alias("n"), F.min(own != name).alias("_part"))
    return found.orderBy("_part", "file").limit(most).drop("_part")


def fingerprint(path):
    """Sixteen digits that stand for a path in its composed spelling."""
    return F.substring(F.sha2(nfc(path), 256), 1, 16)


def nfc(text):
    """Marks composed with their letters; Spark has no function for it, and texts of plain ASCII do not need it."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    return F.when(F.octet_length(text) == F.length(text), text).otherwise(compose(text))


def path_repairs(chunks: DataFrame) -> DataFrame:
    """(id, source_file, file_id): chunks whose path is not in composed spelling, or whose fingerprint is missing or another's, as they should be."""
    right = chunks.where(F.col("source_file").isNotNull()).withColumn("_path", nfc(F.col("source_file"))).withColumn("_print", fingerprint(F.col("source_file")))
    wrong = (F.col("_path") != F.col("source_file")) | ~F.col("file_id").eqNullSafe(F.col("_print"))
    return right.where(wrong).select("id", F.col("_path").alias("source_file"), F.col("_print").alias("file_id"))


def named(collections: DataFrame, search: str) -> DataFrame:
    """Collections whose name holds ``search``, case and marks aside; all of them if it is blank."""
    return collections.where(F.contains(T.unmarked(F.trim("name")), F.lit(T.fold_word(search.strip())))) if search.strip() else collections


def with_saved(filters: DataFrame, new: DataFrame) -> DataFrame:
    """Saved filters (collection, name, filter, saved_at) with ``new`` ones, the latest of each collection and trimmed name."""
    both = filters.unionByName(new).withColumn("name", F.trim("name"))
    return both.groupBy("collection", "name").agg(F.max_by(F.struct("filter", "saved_at"), F.struct("saved_at", "filter")).alias("_f")).select("collection", "name", "_f.*")


def cache_key(model, text):
    """Key of a cached vector: line ends unified, blanks at line ends dropped."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.sha2(F.concat(model, F.lit(":"), clean), 256)


def uncached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts whose vector is not cached: key, text."""
    keyed = texts.select(cache_key(F.lit(model), F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")
