"""What the operators of this subpackage share.

Shared storage: lineage is cut by writing tables under the folder named by
``spark.checkpoint.dir``, which driver and executors both see, so a lost
executor costs a reread and never a wrong or missing row.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark delete a query's shuffle files as soon as its result is stored.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

FREQUENT = 10_000  # a key on more than one row in so many is frequent
LOT = 4096  # copies of a row that one task makes
#: Rows with whole texts come to Python so many at once, as each batch is held on both sides.
FEW_ROWS = {"spark_sql_execution_arrow_maxRecordsPerBatch": "1000"}

_written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def held(spark: SparkSession, **settings: str):
    """``settings`` of Spark, underscores for dots, for a while."""
    settings = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the cut in the lineage.

    Its shuffle files go as soon as the table is there. ``settings`` of Spark,
    underscores for dots, hold while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    with held(spark, **{CLEAN_UP.replace(".", "_"): "true", **settings}):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table from ``written`` that no result will read again."""
    path = df.written_to
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; call it once the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by content.

    Rows that agree in every column share the key; all operators give such rows
    the same result, so the key works with null or repeated ids, and unlike a
    generated id it survives the recomputation of a lost partition.
    """
    def part(seed: int) -> Column:
        cols = [F.lit(seed)]
        for c in columns:
            cols += [F.col(c), F.col(c).isNull()]
        return F.xxhash64(*cols)

    return [part(11).alias("key_a"), part(29).alias("key_b")]


def join_unevenly(rows: DataFrame, other: DataFrame, key: str, n: int) -> DataFrame:
    """Inner join of ``n`` rows with ``other``, which has each ``key`` once, however many rows share a key.

    Keys of more than one row in 10 000, so fewer than 10 000 of them, are found
    in a broadcast table; the others meet by shuffle.
    """
    frequent = written(rows.groupBy(key).count().where(F.col("count") > max(1, n // FREQUENT)).select(key), "frequent")
    here = rows.join(F.broadcast(other.join(F.broadcast(frequent), key, "left_semi")), key)
    there = rows.join(F.broadcast(frequent), key, "left_anti").join(other, key)
    return here.unionByName(there)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column; many copies are made in many tasks."""
    lots = rows.withColumn("lot_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(LOT).cast("long"))))
    lots = lots.repartition(F.xxhash64(*lots.columns))
    return lots.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.col(times) - F.col("lot_"))))).drop("lot_", "copy_", times)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser, elementwise."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column end to end, and each row's bounds in them (null: empty)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int):
    """Consecutive row ranges of at most ``most`` bytes each, or of one longer row."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last
        first = last
