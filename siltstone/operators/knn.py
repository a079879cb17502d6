"""Exact nearest neighbours: parts of the rows of bounded size, each met by the queries that need it, merged by distance.

A part's rows are held by one task while queries stream past; it keeps the best
of the part for each query, and what the parts kept is merged by query. Up to
``PART_ROWS`` rows are one part. Beyond that, rows are dealt to the nearest of a
few pivots and by rings of distance around it; rings of one pivot and of pivots
near each other fill a part together. Every query first meets one part
close to it; its k-th distance there is a radius, and the triangle inequality
tells which other parts can hold anything nearer. Equal vectors count once, as
rows with their smallest ids and as queries with one representative.

Where little can be ruled out every query meets every part, which is quadratic.
Queries then go in rounds that send about as many copies of them as there are
rows, and only the best of a round is kept, so disk grows with the rows alone.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered

PART_ROWS = 16_384  # rows that a task holds, about
QUERY_BATCH = 512  # queries multiplied at once
MOST_PIVOTS = 1024
RINGS = 64  # around a pivot, at most
SLACK = 4e-6  # of chords, relative to the largest component: beyond what rounding can hide
FREQUENT = 10_000  # a vector on more than one query in so many is joined by broadcast
SENT_ROWS = 500_000  # copies of queries sent to parts in one round, where the rows are not more
PAIRS = 32_768  # pairs of vectors multiplied one by one at once
NEAR = 1e-6  # relative: products so close below a limit are looked at exactly
#: Lets Spark delete shuffle files as soon as what was made of them is stored.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    product = queries @ rows.T
    if metric == "ip":
        return 1 - product
    if metric == "l2":
        return np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * product, 0)
    n = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
    return 1 - np.divide(product, n, out=np.zeros_like(product), where=n > 0)


def within(queries: np.ndarray, rows: np.ndarray, metric: str, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the pairs no farther apart than each query's ``most``, rounded as all are."""
    if metric != "l2" or not np.isfinite(most).all():
        d = np.round(distances(queries, rows, metric), 12)
        query, at = np.nonzero((d <= most[:, None]) & np.isfinite(d))
        return query, at, d[query, at]
    product, a, b = queries @ rows.T, (queries**2).sum(1), (rows**2).sum(1)
    query, at = np.nonzero(2 * product >= (a - most - NEAR * (a + most) - 1e-12)[:, None] + ((1 - NEAR) * b)[None])
    d = np.round(np.maximum(a[query] + b[at] - 2 * product[query, at], 0), 12)
    kept = d <= most[query]
    return query[kept], at[kept], d[kept]


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, null ones and those without a finite length as null, and the lengths."""
    n = np.linalg.norm(v, axis=1)
    return np.divide(v, n[:, None], out=np.zeros_like(v), where=((n > 0) & np.isfinite(n))[:, None]).astype(np.float32), n


def nearest_angles(queries: np.ndarray, rows: np.ndarray, unit: np.ndarray, n: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine distance) of all pairs within each query's ``most`` that can be among its ``k`` nearest.

    Single precision, beyond its rounding, tells which pairs these may be; only
    those are computed in double precision, each for itself, so that equal
    vectors are equally far wherever they lie. ``unit`` and ``n`` are ``units`` of the rows.
    """
    slack, odd = (rows.shape[1] + 16) * 2.0 ** -23, ~np.isfinite(n)
    asked, length = units(queries)
    product = asked @ unit.T
    product[:, odd] = np.inf
    found = product >= (1 - most - slack)[:, None]
    k += int(odd.sum())
    if k < len(rows) and np.count_nonzero(found) > 8 * k * len(queries):
        found = product >= np.maximum(1 - most - slack, np.partition(product, -k, axis=1)[:, -k] - 2 * slack)[:, None]
    query, at = np.nonzero(found)
    d = np.empty(len(query))
    for lo in range(0, len(query), PAIRS):
        q, r = query[lo: lo + PAIRS], at[lo: lo + PAIRS]
        dot, size = np.einsum("ij,ij->i", queries[q], rows[r]), length[q] * n[r]
        d[lo: lo + PAIRS] = 1 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
    d = np.round(d, 12)
    kept = (d <= most[query]) & np.isfinite(d)
    return query[kept], at[kept], d[kept]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What Spark shuffles meanwhile goes when the result it was for is there."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def _best_of_parts(own: DataFrame, sent: DataFrame, parts: int, k: int, metric: str, skip_self: bool, max_distance: float | None) -> DataFrame:
    """(query_id, part, id, distance): the best ``k`` of each part for each query sent there; both frames are (part, asks, id, v, reach).

    Nothing beyond a query's ``reach`` counts (null: all does). Where parts are
    few, a part's queries are dealt to several tasks, each with its rows.
    """

    def run(batches):
        import pyarrow as pa

        part, held, matrices = None, {}, {}

        def best_of(ids, vectors, reach, own, x, *sizes):
            row, at, d = nearest_angles(vectors, x, *sizes, reach, k + skip_self) if metric == "cosine" else within(vectors, x, metric, reach)
            i = own[at]
            if skip_self:
                other = ids[row] != i
                row, d, i = row[other], d[other], i[other]
            if len(row) > k:  # all that tie with the k-th stay until ids decide
                order = np.lexsort((i, d, row))
                row, d, i = row[order], d[order], i[order]
                new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
                row, d, i = row[rank < k], d[rank < k], i[rank < k]
            return ids[row], i, d

        def limited(ids, vectors, reach, own, x, *sizes):
            """As ``best_of``, where some reach everything: the k-th distance is their reach."""
            if metric == "cosine" or k + 1 >= len(own) or np.isfinite(reach).all():
                return best_of(ids, vectors, reach, own, x, *sizes)
            d = np.round(distances(vectors, x, metric), 12)
            if skip_self:
                d[ids[:, None] == own[None]] = np.inf
            return best_of(ids, vectors, np.minimum(reach, np.partition(d, k - 1, axis=1)[:, k - 1]), own, x)

        for b in batches:
            number, asks, size = (np.asarray(x) for x in (b.column(0), b.column(1), b.column(3).value_lengths()))
            cut = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])])) if len(number) else []
            for lo, hi in zip(cut, [*cut[1:], len(number)]):
                if number[lo] != part:
                    part, held, matrices = number[lo], {}, {}
                for dim in np.unique(size[lo:hi]).tolist():
                    of = b.slice(lo, hi - lo).filter(pa.array(size[lo:hi] == dim))
                    ids, v = np.asarray(of.column(2)), np.asarray(of.column(3).flatten(), float).reshape(-1, dim)
                    if not asks[lo]:
                        held.setdefault(dim, []).append((ids, v))
                        continue
                    if dim in held:
                        matrices[dim] = tuple(np.concatenate(x) for x in zip(*held.pop(dim)))
                        matrices[dim] += units(matrices[dim][1]) if metric == "cosine" else ()
                    reach = of.column(4).fill_null(np.inf if max_distance is None else max_distance).to_numpy(zero_copy_only=False)
                    for at in range(0, len(ids) if dim in matrices else 0, QUERY_BATCH):
                        found = limited(*(x[at: at + QUERY_BATCH] for x in (ids, v, reach)), *matrices[dim])
                        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(np.full(len(found[0]), part)), *(pa.array(x) for x in found[1:])], ["query_id", "part", "id", "distance"])

    tasks = max(1, -(-2 * own.sparkSession.sparkContext.defaultParallelism // parts))
    here = own.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    both = here.unionByName(sent.withColumn("task", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(tasks)).cast("int")))
    both = both.repartitionById(parts * tasks, (F.col("part") * tasks + F.col("task")).cast("int")).sortWithinPartitions("part", "asks")
    return both.drop("task").mapInArrow(run, "query_id long, part long, id long, distance double")


def _in_rounds(asked: DataFrame, copies: int, n: int, best) -> DataFrame:
    """``best(asked)``; where more ``copies`` of the queries are sent than there are rows (``n``), of a share of them at a time, each stored."""
    rounds = max(1, -(-copies // max(SENT_ROWS, n)))
    if rounds == 1:
        return best(asked)
    done = []
    for r in range(rounds):
        with shuffles_dropped(asked.sparkSession):
            done.append(best(asked.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(rounds)) == r)).checkpoint())
    return reduce(DataFrame.unionByName, done)


@dataclass
class Parts:
    """Where rows lie: groups of one pivot and ring, (cell, lo, hi, first part, parts, rows of a part) each; cell -1 holds what has no place among the pivots."""

    pivots: np.ndarray
    width: float
    metric: str
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    many: np.ndarray
    rows: np.ndarray

    def points(self, v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v, axis=1)[:, None] if self.metric == "cosine" else v

    def usual(self, v: np.ndarray) -> np.ndarray:
        """Rows that have a place among the pivots."""
        if v.shape[1] != self.pivots.shape[1]:
            return np.zeros(len(v), bool)
        return (np.linalg.norm(v, axis=1) > 0) if self.metric == "cosine" else np.ones(len(v), bool)

    def to_pivots(self, v: np.ndarray) -> np.ndarray:
        p = self.points(v)
        return np.sqrt(np.maximum((p * p).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * p @ self.pivots.T, 0))

    def placed(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, ring) of each row."""
        cell, far = np.full(len(v), -1), np.zeros(len(v))
        usual = self.usual(v)
        if usual.any():
            d = self.to_pivots(v[usual])
            cell[usual] = d.argmin(1)
            far[usual] = d.min(1)
        return cell, far, np.minimum(far / self.width, RINGS - 1).astype(int) if self.width > 0 else np.zeros(len(v), int)

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """For each query and group: no row there is nearer than this, as a chord or length."""
        out = np.full((len(v), len(self.cell)), np.inf)
        odd, usual = self.cell < 0, self.usual(v)
        if usual.any():
            d = self.to_pivots(v[usual])
            own, at = d.min(1)[:, None], d[:, self.cell]
            out[usual] = np.maximum(np.maximum(self.lo - at, at - self.hi), np.maximum((at - own) / 2, 0))
            # a null vector is at cosine distance 1 from all
            out[np.ix_(usual, odd)] = np.sqrt(2) if self.metric == "cosine" else np.inf
        alike = v.shape[1] == self.pivots.shape[1]
        out[np.ix_(~usual, odd)] = 0
        if alike:
            out[np.ix_(~usual, ~odd)] = np.sqrt(2)
        return out - SLACK * (1 + np.abs(self.points(v[usual])).max(initial=0) + np.abs(self.pivots).max())

    def first_parts(self, v: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """For each query one part close to it, of at least ``k`` rows if there is one."""
        group = np.where(self.rows >= k, bounds, bounds + 1e300).argmin(1)
        return self.first[group] + ids % self.many[group]

    def radius(self, distance: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(distance, 0) * (2 if self.metric == "cosine" else 1))  # l2 is squared


def _by_dimension(batch, at: int):
    """(row numbers, vectors) of a batch for each dimension of its column ``at``."""
    size = np.asarray(batch.column(at).value_lengths())
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, np.asarray(batch.column(at).take(rows).flatten(), float).reshape(-1, dim)


def dealt_by_pivots(kept: DataFrame, n: int, metric: str) -> tuple[DataFrame, Parts] | None:
    """((part, asks, id, v), where they lie) of ``n`` rows (id, v); None if no vector can be a pivot."""
    import pyarrow as pa

    dims = kept.where(F.exists("v", lambda x: x != 0)).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return None
    most = min(MOST_PIVOTS, max(8, -(-4 * n // PART_ROWS)))
    chosen = kept.where((F.size("v") == dims["dim"]) & F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(most).collect()
    empty = np.zeros(0)
    where = Parts(np.array([r["v"] for r in chosen], float), 0.0, metric, *[empty] * 6)
    where.pivots = where.points(where.pivots)
    apart = where.to_pivots(where.pivots)
    np.fill_diagonal(apart, np.inf)
    near = apart.min(1)
    where.width = float(np.median(near[np.isfinite(near)])) / 4 if np.isfinite(near).any() else 0.0

    def place(batches):
        for b in batches:
            for rows, v in _by_dimension(b, 1):
                cell, far, ring = where.placed(v)
                of = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([of.column(0), of.column(1), pa.array(cell, pa.int32()), pa.array(far), pa.array(ring, pa.int32())], ["id", "v", "cell", "far", "ring"])

    placed = kept.select("id", "v").mapInArrow(place, f"id long, v {kept.schema['v'].dataType.simpleString()}, cell int, far double, ring int").checkpoint()
    groups = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()  # at most RINGS a pivot
    chain = {-1: -1} | {c: i for i, c in enumerate(_chained(apart))}
    groups.sort(key=lambda g: (chain[g["cell"]], g["ring"]))
    where.cell, where.lo, where.hi, where.rows = (np.array([g[c] for g in groups]) for c in ("cell", "lo", "hi", "n"))
    where.many = -(-where.rows // PART_ROWS)
    where.first, where.rows = _filled(where.rows, where.many, where.cell < 0)
    table = kept.sparkSession.createDataFrame([(int(g["cell"]), int(g["ring"]), int(f), int(m)) for g, f, m in zip(groups, where.first, where.many)], "cell int, ring int, first long, many long")
    own = placed.join(F.broadcast(table), ["cell", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).alias("part"), F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("double").alias("reach"))
    return own, where


def _chained(apart: np.ndarray) -> list[int]:
    """Pivots in an order in which each follows one close to it."""
    left, out = np.ones(len(apart), bool), [0]
    for _ in range(len(apart) - 1):
        left[out[-1]] = False
        out.append(int(np.where(left, apart[out[-1]], np.inf).argmin()) if np.isfinite(apart[out[-1]][left]).any() else int(left.argmax()))
    return out


def _filled(rows: np.ndarray, many: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first part, rows of the part) of each group: neighbours share a part while they fit, those of many parts have their own."""
    first, part, total = np.zeros(len(rows), np.int64), 0, 0
    for i in range(len(rows)):
        if i and (many[i] > 1 or many[i - 1] > 1 or odd[i] != odd[i - 1] or total + rows[i] > PART_ROWS):
            part, total = part + many[i - 1], 0
        first[i], total = part, total + rows[i]
    return first, np.bincount(first, rows)[first] // many


def _first_parts(asked: DataFrame, where: Parts, k: int) -> DataFrame:
    """Each query (id, v) with one part close to it, of at least ``k`` rows if there is one: (part, asks, id, v, reach)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for rows, v in _by_dimension(b, 1):
                for lo in range(0, len(rows), 64):
                    of = b.take(pa.array(rows[lo: lo + 64]))
                    part = where.first_parts(v[lo: lo + 64], np.asarray(of.column(0)), where.bounds(v[lo: lo + 64]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.ones(len(part)), pa.int32()), of.column(0), of.column(1), pa.nulls(len(part), pa.float64())], ["part", "asks", "id", "v", "reach"])

    return asked.select("id", "v").mapInArrow(run, f"part long, asks int, id long, v {asked.schema['v'].dataType.simpleString()}, reach double")


def _other_parts(asked: DataFrame, where: Parts, k: int) -> DataFrame:
    """Queries (id, v, reach) with every part but their first that may hold something within ``reach`` (null: anything): (parts, asks, id, v, reach)."""

    def run(batches):
        import pyarrow as pa

        every = int((where.first + where.many).max())
        for b in batches:
            for rows, v in _by_dimension(b, 1):
                for lo in range(0, len(rows), 64):
                    of = b.take(pa.array(rows[lo: lo + 64]))
                    reach = of.column(2).to_numpy(zero_copy_only=False)
                    radius = np.where(np.isnan(reach), np.inf, where.radius(reach))
                    bounds = where.bounds(v[lo: lo + 64])
                    query, group = np.nonzero((bounds <= radius[:, None]) & np.isfinite(bounds))
                    meets = np.zeros((len(reach), every + 1), bool)
                    meets[query, where.first[group]] = True
                    for i in np.flatnonzero(where.many[group] > 1):
                        meets[query[i], where.first[group[i]]: where.first[group[i]] + where.many[group[i]]] = True
                    meets[np.arange(len(reach)), where.first_parts(v[lo: lo + 64], np.asarray(of.column(0)), bounds, k)] = False
                    query, part = np.nonzero(meets)
                    parts = pa.ListArray.from_arrays(pa.array(np.searchsorted(query, np.arange(len(reach) + 1)), pa.int32()), pa.array(part, pa.int32()))
                    yield pa.RecordBatch.from_arrays([parts, pa.array(np.ones(len(reach)), pa.int32()), *of.columns], ["parts", "asks", "id", "v", "reach"])

    return asked.select("id", "v", "reach").mapInArrow(run, f"parts array<int>, asks int, id long, v {asked.schema['v'].dataType.simpleString()}, reach double")


def _searched(kept: DataFrame, asked: DataFrame, n: int, k: int, metric: str, max_distance: float | None) -> DataFrame | None:
    """(query_id, best) with the ``k`` nearest (distance, id) of each query, by pivots; None if the rows have none."""
    found = dealt_by_pivots(kept, n, metric)
    if found is None:
        return None
    own, where = found
    parts = int((where.first + where.many).max())
    first = _best_of_parts(own, _first_parts(asked, where, k), parts, k, metric, False, max_distance).checkpoint()
    reach = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))

    def reaching(asked):
        known = asked.join(reach.select(F.col("query_id").alias("id"), "reach"), "id", "left")
        return _other_parts(known.select("id", "v", (F.col("reach") if max_distance is None else F.coalesce("reach", F.lit(float(max_distance)))).alias("reach")), where, k)

    def best(asked):
        sent = reaching(asked).select(F.explode(F.col("parts").cast("array<long>")).alias("part"), "asks", "id", "v", "reach")
        rest = _best_of_parts(own, sent, parts, k, metric, False, max_distance)
        every = first.join(asked.select(F.col("id").alias("query_id")), "query_id", "left_semi").unionByName(rest).select("query_id", "id", "distance")
        place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
        return every.withColumn("_n", place).where(F.col("_n") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("best"))

    copies = reaching(asked).agg(F.sum(F.size("parts"))).first()[0] or 0
    return _in_rounds(asked, copies, n, best)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", skip_self: bool = False, max_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance, position): the ``k`` nearest rows of every query, ties by id.

    Both frames have ``id_col`` (long) and ``vector_col``; rows whose vector is
    null are passed over, and a query is compared with rows of its dimension.
    Distances are rounded to twelve digits, so that equal vectors tie. An inner
    product obeys no triangle inequality: there all queries meet all parts.
    """
    floats = {df.schema[vector_col].dataType.simpleString() for df in (rows, queries)} == {"array<float>"}

    def usable(df):  # single components travel as such and are made double in the tasks
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if floats else "array<double>").alias("v")).where("v is not null and id is not null")

    kept, asked = usable(rows), usable(queries)
    n = kept.count()
    parts = max(1, -(-n // PART_ROWS))
    if parts > 1 and metric != "ip":
        ordered.with_checkpoints(rows.sparkSession)
        most, name = k + bool(skip_self), [F.xxhash64(F.lit(3), "v").alias("v_a"), F.xxhash64(F.lit(5), "v").alias("v_b")]
        same = W.partitionBy("v_a", "v_b").orderBy("id")
        few = kept.select("id", "v", *name).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).select("id", "v")  # cut down before the shuffle, too
        named = asked.select("id", "v", *name)
        with shuffles_dropped(rows.sparkSession):
            alike = named.groupBy("v_a", "v_b").agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count("*").alias("_copies")).checkpoint()
            found = _searched(few, alike.select("id", "v"), n, most, metric, max_distance)
        if found is not None:
            found = alike.select("v_a", "v_b", "_copies", F.col("id").alias("query_id")).join(found, "query_id").drop("query_id")
            limit = max(1, alike.agg(F.sum("_copies")).first()[0] or 0) // FREQUENT
            often = found.where(F.col("_copies") > max(1, limit)).drop("_copies")  # fewer than FREQUENT
            seldom = found.where(F.col("_copies") <= max(1, limit)).drop("_copies")
            named = named.select(F.col("id").alias("query_id"), "v_a", "v_b")
            met = named.join(F.broadcast(often), ["v_a", "v_b"]).unionByName(named.join(seldom, ["v_a", "v_b"]))
            best = F.filter("best", lambda x: x["id"] != F.col("query_id")) if skip_self else F.col("best")
            out = met.select("query_id", F.posexplode(F.slice(best, 1, k)).alias("at", "b"))
            return out.select("query_id", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"), (F.col("at") + 1).alias("position"))

    reach = F.lit(None).cast("double").alias("reach")
    own = kept.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).alias("asks"), "id", "v", reach)
    place = W.partitionBy("query_id").orderBy("distance", "id")

    def best(asked):
        sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("asks"), "id", "v", reach)
        found = _best_of_parts(own, sent, parts, k, metric, skip_self, max_distance).drop("part")
        return found.withColumn("position", F.row_number().over(place)).where(F.col("position") <= k)

    if parts == 1:
        return best(asked)
    ordered.with_checkpoints(rows.sparkSession)
    return _in_rounds(asked, parts * asked.count(), n, best)


def near_duplicate_pairs(rows: DataFrame, neighbours: int = 5, within: float = 0.05, acknowledged: DataFrame | None = None, **named) -> DataFrame:
    """(a, b, distance), a < b: rows among each other's ``neighbours`` nearest within a distance, less the acknowledged pairs (a, b)."""
    found = nearest(rows, rows, neighbours, skip_self=True, max_distance=within, **named)
    pairs = found.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return pairs if acknowledged is None else pairs.join(acknowledged.select("a", "b"), ["a", "b"], "left_anti")
