"""Scans in order: sums, batches and token buckets dealt over many parts against one pass over all rows."""

import collections
import datetime
import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ordered
from siltstone.sources import collections as C
from siltstone.streaming import events as E


def test_running_sums_over_many_parts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([3, 3, 3, rng.randrange(9)]), rng.choice([None, rng.randrange(100)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, at long, n long").repartition(3)
    for keys in ([], ["k"]):
        got = {r["id"]: r["before"] for r in ordered.running(df, [F.desc("at"), F.col("id")], {"before": F.col("n")}, 90, keys).collect()}
        sums = collections.Counter()
        for i, k, at, n in sorted(rows, key=lambda r: (-r[2], r[0])):
            k = k if keys else 0
            assert got[i] == sums[k]
            sums[k] += n or 0


def test_retention_of_equal_times_over_many_parts(spark):
    day = datetime.datetime(2024, 5, 1)
    rows = [(i, "u" if i % 3 else None, day if i % 4 else day + datetime.timedelta(hours=i % 7), 1 + i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, user string, at timestamp, size long")
    for keys, most in ([], 700), (["user"], 300):
        used, want = collections.Counter(), set()
        for i, u, at, n in sorted(rows, key=lambda r: (-r[2].timestamp(), r[0])):
            used[u if keys else 0] += n
            if used[u if keys else 0] <= most:
                want.add(i)
        assert {r["id"] for r in C.keep_newest(df, "at", "size", most, keys=keys, parts=80).collect()} == want


def filled(sizes, most_rows, room):
    out, opened, n, used = [], 0, 0, 0
    for s in sizes:
        if s > room:
            out.append(None)
            continue
        if not opened or n >= most_rows or used + s > room:
            opened, n, used = opened + 1, 0, 0
        n, used = n + 1, used + s
        out.append(opened - 1)
    return out


@pytest.mark.parametrize("parts", [1, 7, 100])
def test_batches_do_not_depend_on_the_parts(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 400]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(5)
    got = {r["id"]: r["batch"] for r in C.batches(df, 4, 100 + 28, F.col("n"), envelope=28, parts=parts).collect()}
    assert [got[i] for i in range(700)] == filled(sizes, 4, 100)


def test_batches_of_equal_order_follow_the_input(spark):
    df = spark.createDataFrame([(7, 10)] * 30 + [(7, 60)] * 10, "id long, n long").coalesce(1)
    for order in ("id", None):
        got = [(r["n"], r["batch"]) for r in C.batches(df, 3, 228, F.col("n"), order=order, parts=90).collect()]
        assert sorted(got, key=lambda x: x[1]) == list(zip([10] * 30 + [60] * 10, filled([10] * 30 + [60] * 10, 3, 100)))
    assert C.batches(df.limit(0), 3, 228, F.col("n")).collect() == []


def test_notes_of_batches_compose():
    rng = random.Random(3)
    for _ in range(300):
        fold = C.Filling(rng.randrange(1, 6), 128 + rng.randrange(1, 40), 128)
        cuts = [[rng.randrange(0, 45) for _ in range(rng.randrange(0, 9))] for _ in range(4)]
        blocks = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64())], ["n"]) for c in cuts]
        note, state = fold.note(blocks[0]), fold.start
        for b in blocks[1:]:
            note = fold.then(note, fold.note(b))
        begin = rng.choice([(0, 0, 0), (3, rng.randrange(1, fold.most_rows + 1), rng.randrange(0, fold.room + 1))])
        state = begin
        for b in blocks:
            assert fold.after(fold.note(b), state) == fold.apply(b, state)[0]
            state = fold.apply(b, state)[0]
        assert fold.after(note, begin) == state


def test_notes_of_buckets_compose():
    rng = random.Random(4)
    for case in range(300):
        fold = E.TokenBucket(rng.choice([0.5, 1, 7, 60, 90]), rng.choice([1, 2, 5, 20]))
        t, blocks = 0, []
        for _ in range(4):
            times = []
            for _ in range(rng.randrange(1, 30)):
                t += rng.choice([0, 0, 1, 1000, 400_000, 1_000_000, 30_000_000, 700_000_000 if case % 2 else 0])
                times.append(t)
            blocks.append(pa.RecordBatch.from_arrays([pa.array(times, pa.int64())], ["t"]))
        note = fold.note(blocks[0])
        for b in blocks[1:]:
            note = fold.then(note, fold.note(b))
        assert len(note[2]) <= (120 if fold.most == fold.token else 2 * fold.most // fold.token + 3)
        for begin in [None, *((rng.randrange(fold.most + 1), -rng.randrange(2) * 5) for _ in range(8))]:
            state = begin
            for b in blocks:
                assert fold.after(fold.note(b), state) == fold.apply(b, state)[0]
                state = fold.apply(b, state)[0]
            assert fold.after(note, begin) == state


class Plain:
    """A bucket in exact fractions, one event after the other."""

    def __init__(self, per_minute, burst):
        self.rate, self.most = Fraction(str(per_minute)) / 60_000_000, Fraction(burst)
        self.tokens, self.last = self.most, None

    def take(self, t):
        if self.last is not None:
            self.tokens = min(self.most, self.tokens + (t - self.last) * self.rate)
        self.last = t
        if self.tokens >= 1:
            self.tokens -= 1
            return 0
        return max(1, -((self.tokens - 1) // (self.rate * 1_000_000)))


@pytest.mark.parametrize("parts", [1, 70])
def test_rate_limits_of_a_busy_client_and_of_all(spark, parts):
    rng = random.Random(parts)
    t, rows, begin = 0, [], datetime.datetime(2024, 1, 1)
    for i in range(500):
        t += rng.choice([0, 0, 200_000, 700_000, 5_000_000])
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), begin + datetime.timedelta(microseconds=t), rng.random() < 0.4, t))
    df = spark.createDataFrame([r[:4] for r in rows], "event_id long, user_id long, ts timestamp, w boolean").repartition(4)
    got = {r["event_id"]: (r["allowed"], r["refused_by"], r["retry_after"]) for r in E.rate_limited(df, "user_id", 30, 6, writes=F.col("w"), writes_per_minute=12, common=(45, 9), parts=parts).collect()}
    clients, writers, common, seen = {}, {}, Plain(45, 9), collections.Counter()
    for i, c, _, w, t in rows:
        by, wait = "client", clients.setdefault(c, Plain(30, 6)).take(t)
        if not wait and w:
            by, wait = "write", writers.setdefault(c, Plain(12, 3)).take(t)
        if not wait:
            by, wait = "common", common.take(t)
        assert got[i] == ((False, by, wait) if wait else (True, None, 0))
        seen[by if wait else None] += 1
    assert len(seen) == 4


def test_stream_of_rate_limits_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(3), begin + datetime.timedelta(milliseconds=400 * i + 200_000 * (i // 40)), rng.random() < 0.5) for i in range(120)]
    schema = "event_id long, user_id long, ts timestamp, w boolean"
    for k in range(3):
        spark.createDataFrame(rows[40 * k: 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = E.rate_limited_stream(stream, "user_id", 30, 4, writes=F.col("w"), writes_per_minute=12)
        out.writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = E.rate_limited(spark.createDataFrame(rows, schema), "user_id", 30, 4, writes=F.col("w"), writes_per_minute=12)
    got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (spark.table("buckets"), batch))
    assert got == want and len(got) == 120
