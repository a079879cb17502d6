"""Streams of events: rate limits, quotas, running totals, audit sinks, folder watching."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered

RATE_PER_MINUTE, BURST = 120, 20  # of a client
WRITES_PER_MINUTE = 30  # of a client, with half its burst
COMMON_PER_MINUTE, COMMON_BURST = 600, 100  # of all clients together
MINUTE = 60_000_000  # microseconds


class TokenBucket(ordered.Fold):
    """A bucket refilled at a steady rate up to its burst; each event takes a token or is refused.

    All is counted in integers, so results do not depend on how events are cut
    into stretches: a token is ``token`` units, a microsecond refills ``refill``.
    The state is (units at the last event, its time), None for a full bucket.

    A stretch of events is noted as (first time, last time, pieces): units left
    at its end as a function of the units at its begin, just before the first
    event takes. A piece (from, moved, value) says that units from there on are
    shifted by ``moved``, or give ``value`` where the bucket has been full or
    is so by then. Two amounts that differ by n tokens differ by at most n in
    what they admit, so there are about twice as many pieces as tokens; a bucket
    of a single token may have one for each event within the refill of a token.
    """

    start = None
    adds = "allowed boolean, retry_after int"

    def __init__(self, per_minute: float, burst: float):
        rate = Fraction(str(max(per_minute, 0))).limit_denominator(10**6) or Fraction(1)
        self.refill, self.token = rate.numerator, MINUTE * rate.denominator
        self.most = int(max(1, burst) * self.token)

    def _refilled(self, pieces: list[tuple], units: int) -> list[tuple]:
        out = []
        for i, (lo, moved, value) in enumerate(pieces):
            if value is not None:
                out.append((lo, None, min(self.most, value + units)))
                continue
            full = self.most - moved - units  # from here on the bucket is full
            end = pieces[i + 1][0] if i + 1 < len(pieces) else self.most + 1
            if full > lo:
                out.append((lo, moved + units, None))
            if full < end:
                out.append((max(lo, full), None, self.most))
        return self._joined(out)

    def _taken(self, pieces: list[tuple]) -> list[tuple]:
        out = []
        for i, (lo, moved, value) in enumerate(pieces):
            if value is not None:
                out.append((lo, None, value - self.token if value >= self.token else value))
                continue
            enough = self.token - moved  # from here on a token is there
            end = pieces[i + 1][0] if i + 1 < len(pieces) else self.most + 1
            if enough > lo:
                out.append((lo, moved, None))
            if enough < end:
                out.append((max(lo, enough), moved - self.token, None))
        return self._joined(out)

    @staticmethod
    def _joined(pieces: list[tuple]) -> list[tuple]:
        return [p for i, p in enumerate(pieces) if not i or p[1:] != pieces[i - 1][1:]]

    def note(self, batch) -> tuple:
        times = batch.column(0).to_pylist()
        pieces, last, i = [(0, 0, None)], times[0], 0
        while i < len(times) and (len(pieces) > 1 or pieces[0][2] is None):
            gap = times[i] - last
            pieces, last, i = self._taken(self._refilled(pieces, gap * self.refill) if gap else pieces), times[i], i + 1
        if i < len(times):  # whatever was there at the begin, the end is the same
            (units, _), _ = self._replayed(times[i:], (pieces[0][2], last))
            pieces = [(0, None, units)]
        return times[0], times[-1], pieces

    def _at(self, pieces: list[tuple], units: int) -> int:
        _, moved, value = pieces[bisect.bisect_right(pieces, units, key=lambda p: p[0]) - 1]
        return units + moved if value is None else value

    def _begun(self, state, time: int) -> int:
        return self.most if state is None else min(self.most, state[0] + max(0, time - state[1]) * self.refill)

    def after(self, note: tuple, state):
        first, last, pieces = note
        return self._at(pieces, self._begun(state, first)), last

    def then(self, note: tuple, later: tuple) -> tuple:
        units, out = (later[0] - note[1]) * self.refill, []
        for i, (lo, moved, value) in enumerate(here := self._refilled(note[2], units)):
            if value is not None:
                out.append((lo, None, self._at(later[2], value)))
                continue
            end = here[i + 1][0] if i + 1 < len(here) else self.most + 1
            for j, (begin, more, fixed) in enumerate(later[2]):
                until = later[2][j + 1][0] if j + 1 < len(later[2]) else self.most + 1
                if max(lo, begin - moved) < min(end, until - moved):
                    out.append((max(lo, begin - moved), None if more is None else moved + more, fixed))
        return note[0], later[1], self._joined(out)

    def _replayed(self, times: list[int], state) -> tuple:
        """(state after, units of each event before it takes)."""
        units, last = (self.most, times[0] if times else None) if state is None else state
        refill, token, most, met = self.refill, self.token, self.most, []
        for t in times:
            if t > last:
                units = min(most, units + (t - last) * refill)
                last = t
            met.append(units)
            if units >= token:
                units -= token
        return (units, last), met

    def apply(self, batch, state):
        import pyarrow as pa

        state, met = self._replayed(batch.column(0).to_pylist(), state)
        second = 1_000_000 * self.refill
        return state, [pa.array([u >= self.token for u in met], pa.bool_()), pa.array([0 if u >= self.token else max(1, -((u - self.token) // second)) for u in met], pa.int32())]

    def full_at(self, state) -> int:
        """The time from which on the bucket is as if it had never been used."""
        return state[1] - (state[0] - self.most) // self.refill


def _timed(events: DataFrame, key: str, id_col: str, at: str, writes: Column | None, more: list[str] = ()) -> DataFrame:
    """(event_id, client, t, writes); a null client is -1."""
    client, t = F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.unix_micros(F.col(at).cast("timestamp"))
    return events.select(F.col(id_col).cast("long").alias("event_id"), client.alias("client"), t.alias("t"), (F.lit(False) if writes is None else F.coalesce(writes, F.lit(False))).alias("writes"), *more)


def rate_limited(
    events: DataFrame, key: str, per_minute: float = RATE_PER_MINUTE, burst: float = BURST, id_col: str = "event_id", at: str = "ts",
    writes: Column | None = None, writes_per_minute: float = WRITES_PER_MINUTE, common: tuple[float, float] | None = None, parts: int | None = None,
) -> DataFrame:
    """(event_id, client, allowed, refused_by, retry_after) of a batch, its events replayed in order of time.

    An event takes a token of its client's bucket, then, if ``writes`` holds for
    it, one of the client's bucket for writes (half the burst), then, with
    ``common`` (events a minute, burst), one of the bucket over all clients. The
    first without a token refuses it (``client``, ``write``, ``common``), and
    tokens taken before that stay taken. ``retry_after`` are whole seconds.

    Each kind of bucket is one scan in parts, in which neither a busy client nor
    the common bucket is a task's own. Events of one time go by id.
    """
    order, kinds = [F.col("t"), F.col("event_id")], [("client", "client", TokenBucket(per_minute, burst), None)]
    if writes is not None:
        kinds.append(("write", "client", TokenBucket(writes_per_minute, max(1, burst // 2)), "writes"))
    if common:
        kinds.append(("common", None, TokenBucket(*common), None))
    left, done = _timed(events, key, id_col, at, writes), []
    said = ["event_id", "client", "allowed", "refused_by", "retry_after"]
    for name, own, fold, only in kinds:
        spared = left.where(~F.col(only)) if only else None
        asked = ordered.scan(left.where(F.col(only)) if only else left, order, fold, ["t"], own, parts)
        done.append(asked.where(~F.col("allowed")).select("event_id", "client", "allowed", F.lit(name).alias("refused_by"), "retry_after"))
        left = asked.where("allowed").drop("allowed", "retry_after")
        left = left.unionByName(spared) if only else left
    out = left.select("event_id", "client", F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("refused_by"), F.lit(0).alias("retry_after"))
    for d in done:
        out = out.unionByName(d.select(said))
    return out


def rate_limited_stream(
    events: DataFrame, key: str, per_minute: float = RATE_PER_MINUTE, burst: float = BURST, id_col: str = "event_id", at: str = "ts",
    writes: Column | None = None, writes_per_minute: float = WRITES_PER_MINUTE, late: str = "1 minute",
) -> DataFrame:
    """As ``rate_limited`` on a stream, each client's buckets kept as state between batches.

    A timer drops the state of a client once the watermark, ``late`` behind the
    newest event, passes the time at which its buckets are full again: no later
    event can tell, and only clients of the last while take room. It needs the
    RocksDB state store. The common bucket is for batches (``foreachBatch``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    folds = [TokenBucket(per_minute, burst), TokenBucket(writes_per_minute, max(1, burst // 2))]

    class Buckets(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("buckets", "units long, last long, write_units long, write_last long, until long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.held.get() if self.held.exists() else None
            states = [None if held is None or held[i] is None else (int(held[i]), int(held[i + 1])) for i in (0, 2)]
            pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
            allowed, refused, retry = [], [], []
            for t, w in zip(pdf["t"].tolist(), pdf["writes"].tolist()):
                by = None
                for i, name in enumerate(("client", "write") if w else ("client",)):
                    states[i], (units,) = folds[i]._replayed([t], states[i])
                    if units < folds[i].token:
                        by, wait = name, max(1, -((units - folds[i].token) // (1_000_000 * folds[i].refill)))
                        break
                allowed.append(by is None)
                refused.append(by)
                retry.append(0 if by is None else wait)
            until = max(f.full_at(s) for f, s in zip(folds, states) if s) // 1000 + 1
            if held is not None and held[4] is not None:
                self.handle.deleteTimer(int(held[4]))
            self.handle.registerTimer(until)
            self.held.update((*(x for s in states for x in (s or (None, None))), until))
            yield pd.DataFrame({"event_id": pdf["event_id"], "client": pdf["client"], "allowed": allowed, "refused_by": pd.Series(refused, pdf.index, object), "retry_after": retry})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.held.clear()
            return iter([])

        def close(self):
            pass

    rows = _timed(events.withWatermark(at, late), key, id_col, at, writes, [at])
    return rows.groupBy("client").transformWithStateInPandas(Buckets(), "event_id long, client long, allowed boolean, refused_by string, retry_after int", "Append", "EventTime")


def daily_quota(events: DataFrame, key: str, most: int, at: str = "ts") -> DataFrame:
    """(key, day, written, over): what each client wrote a day and how much of it was beyond the quota."""
    day = F.date_trunc("day", F.col(at)).cast("date")
    return events.groupBy(F.col(key), day.alias("day")).agg(F.count("*").alias("written")).withColumn("over", F.greatest(F.col("written") - most, F.lit(0)))


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, mean): sums that a stream keeps complete."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def audit_sink(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to Parquet by day, exactly once."""
    day = events.withColumn("day", F.to_date("ts"))
    return day.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def watch_folder(spark: SparkSession, path: str, schema, sync: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 5, once: bool = False):
    """Call ``sync`` with the rows of new files, a few seconds together, one batch after the other."""
    stream = spark.readStream.schema(schema).parquet(path)
    trigger = {"availableNow": True} if once else {"processingTime": f"{max(1, seconds)} seconds"}
    return stream.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def filtered_audit(events: DataFrame, writes_only: bool = False, collection: str | None = None, search: str = "", write_types: list[str] = (), text: str = "operation") -> DataFrame:
    out = events
    if writes_only:
        out = out.where(F.col(text).isin(list(write_types)))
    if collection is not None:
        out = out.where(F.col("collection") == collection)
    if search:
        out = out.where(F.contains(F.lower(text), F.lit(search.lower())))
    return out
