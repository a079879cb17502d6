"""Scans in one total order that no task has to see whole.

Rows are dealt to parts by ranges of the order and stored with the number of
their part; one pass sums up each part, a second goes on from what all earlier
parts hold. Rows that the order leaves equal follow each other as in the input,
so that a time or key on a third of all rows is dealt to many parts as well.

``running`` adds sums up. ``scan`` carries any state along the order, as long as
what a stretch of rows does to a state can be written down shortly without
knowing the state (a ``Fold``): the first pass notes that for each part, the
driver folds these notes in order, and the second pass starts every part with
the state it would have met.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

PART_ROWS = 250_000  # rows of a part, about, as long as there are
MOST_PARTS = 20_000  # parts: what is broadcast or folded by the driver has at most one row for each


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder; one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='siltstone-')}")
    return spark


def dealt(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` stored in ``parts`` ranges of the order, with ``_part``; within a part they lie in order.

    Rows that the order leaves equal are told apart by ``_tie``, their place in
    the input, which is stored first, as a lost task must not number them anew.
    """
    with_checkpoints(rows.sparkSession)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id()).checkpoint()
    parts = parts or max(1, min(MOST_PARTS, -(-tied.count() // PART_ROWS)))
    keys = [*order, F.col("_tie")]
    return tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None, keys: list[str] = ()) -> DataFrame:
    """``rows`` with columns of ``sums``: what all rows before this one, in the order, hold together of each (a long or double).

    With ``keys``, only rows equal in them are summed up, nulls as one value. A
    null adds nothing. Of the parts only their sums are gathered: one row a part
    and, with keys, two for keys that reach into the next part.
    """
    held = dealt(rows.select("*", *(x.alias(f"_of_{n}") for n, x in sums.items())), [*(F.col(k).asc_nulls_first() for k in keys), *order], parts)
    totals = held.groupBy("_part", *keys).agg(*(F.coalesce(F.sum(f"_of_{n}"), F.lit(0)).alias(f"_all_{n}") for n in sums))
    same = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row a part
    before = same.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.col(k).alias(f"_key_{k}") for k in keys), F.min("_part").over(same).alias("_first"), *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_all_{n}") for n in sums))
    offsets = offsets.where("_part > _first").drop("_first")  # what starts in a part needs no offset
    own = W.partitionBy("_part", *keys).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    local = held.select(*rows.columns, "_part", *(F.coalesce(F.sum(f"_of_{n}").over(own), F.lit(0)).alias(f"_in_{n}") for n in sums)).alias("l")
    offsets = offsets.withColumnRenamed("_part", "_at")
    on = F.col("_part") == F.col("_at")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"_key_{k}"))
    met = local.join(F.broadcast(offsets), on, "left")
    return met.select(*(F.col(f"l.{c}") for c in rows.columns if c not in sums), *((F.col(f"_in_{n}") + F.coalesce(f"_all_{n}", F.lit(0))).alias(n) for n in sums))


class Fold:
    """How a state goes along rows, and how a stretch of rows is noted without knowing the state.

    States and notes are pickled, so they have to be small. A note ``n`` obeys
    ``after(note(b), s) == apply(b, s)[0]`` for a batch ``b`` and any state ``s``
    and ``after(then(m, n), s) == after(n, after(m, s))``.
    """

    start = None  # the state before the first row
    adds = ""  # columns that ``apply`` gives, as a schema

    def note(self, batch):
        raise NotImplementedError

    def then(self, note, later):
        raise NotImplementedError

    def after(self, note, state):
        raise NotImplementedError

    def apply(self, batch, state) -> tuple:
        """(state after, Arrow arrays of the columns added)."""
        raise NotImplementedError


def _stretches(batch, key: int | None) -> Iterator[tuple[object, object]]:
    """(key, rows) of the consecutive rows of a batch that share a key."""
    if key is None:
        yield None, batch
        return
    keys, lo = batch.column(key).to_pylist(), 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[lo]:
            yield keys[lo], batch.slice(lo, i - lo)
            lo = i


def scan(rows: DataFrame, order: list[Column], fold: Fold, uses: list[str], key: str | None = None, parts: int | None = None, start=None) -> DataFrame:
    """``rows`` with the columns of ``fold``, which sees the columns ``uses`` in the order.

    With a ``key`` each of its values, null too, is a scan of its own that
    begins at ``start``, else at ``fold.start``. A value's rows may fill any
    number of parts. A part that holds several values is noted by the state at
    its end alone, as the last of them begins within it.
    """
    start = fold.start if start is None else start
    held = dealt(rows, ([F.col(key).asc_nulls_first()] if key else []) + order, parts)
    own = held.select("_part", *([key] if key else []), *uses)
    at_key, first = (1, 2) if key else (None, 1)

    def notes(batches):
        import pyarrow as pa

        part, begun, head, now, note, state, closed = None, False, None, None, None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            for k, of in _stretches(b, at_key):
                found = fold.note(pa.RecordBatch.from_arrays(of.columns[first:], uses))
                if not begun:
                    begun, head, now, note = True, k, k, found
                elif k != now:
                    closed, now, state = True, k, fold.after(found, start)
                elif closed:
                    state = fold.after(found, state)
                else:
                    note = fold.then(note, found)
        if begun:
            said = pickle.dumps((head, now, closed, state if closed else note))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([said], pa.binary())], ["part", "said"])

    met, now, state = {}, None, start
    for r in own.mapInArrow(notes, "part int, said binary").orderBy("part").toLocalIterator():  # at most MOST_PARTS
        head, last, closed, of = pickle.loads(r["said"])
        state = state if head == now or not key else start
        met[r["part"]] = head, state
        now, state = last, of if closed else fold.after(of, state)
    begin = rows.sparkSession.sparkContext.broadcast(met)
    names, kept, added = held.columns, rows.columns, _parse_datatype_string(fold.adds)
    extra = added.names

    def run(batches):
        import pyarrow as pa

        now, state, fresh = None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            if fresh:
                (now, state), fresh = begin.value[b.column(names.index("_part"))[0].as_py()], False
            out = []
            for k, of in _stretches(b, names.index(key) if key else None):
                if key and k != now:
                    now, state = k, start
                state, columns = fold.apply(pa.RecordBatch.from_arrays([of.column(names.index(c)) for c in uses], uses), state)
                out.append(columns)
            columns = [pa.concat_arrays(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), *columns], [*kept, *extra])

    return held.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
