"""Alignment of tokenizers, compression of vectors and mixing of sources against brute force."""

import collections
import hashlib
import math
import pickle
import random
import re

import numpy as np
import pytest

from siltstone.llm import alignment, heap_lloyd, mixing

from test_llm import DOCS, frame, odd_texts, words


def oracle(spark, sf, name, query, places=None):
    """Rows of a query and of its SQL, with doubles rounded."""
    import duckdb

    from siltstone.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    r = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    return got, sorted(repr(tuple(plain(x[names.index(c)]) for c in cols)) for x in r.fetchall())


# ---- alignment of two tokenizers


def coders():
    import public_tokenizers

    return alignment._load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(texts):
    """Whole texts are encoded, and all pairs of tokens whose bytes overlap are listed."""
    a, a_bytes, b, b_bytes = coders()
    held, counts = [], collections.Counter()
    for t in texts:
        want, x, y = (" " + (t or "")).encode(), a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        if not t or b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            held.append(None)
            continue
        spans = []
        for ids, table in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, f, i in side if lo <= s and f <= e) for side in spans))
            lo = e
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        held.append((len(x), len(y), len(ends), links, ";".join(groups)))
        counts.update(set(links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = h[3]
            out.append((*h[:3], len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(h[4].encode()).hexdigest()))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned_rows(df):
    import public_tokenizers

    out = alignment.align_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def hard_texts():
    rng = random.Random(8)
    glyphs = ["a", "The", "é", " ", "  ", "\t", "\n", " ", "　", "​", "12", "'s", "<s>", "<|endoftext|>", "日", "😀", "...", "\x1c", "\x85", "﻿", "\x00", "<0x41>", "́", " b"]
    out = ["".join(rng.choice(glyphs) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    out += [words(rng, rng.randrange(3, 200)) for _ in range(20)] + odd_texts()
    return out + [None, "", " ", "  ", "\n", "one", "one", "▁", "a ▁b", "x" * 9000, "the " * 6000, "日本語" * 800, "same words here", "same words here"]


def test_alignment(spark):
    texts = hard_texts()
    want = sorted(((i, *r) for i, r in enumerate(brute_alignment(texts))), key=repr)
    assert aligned_rows(frame(spark, texts)) == want


def test_alignment_of_blocks_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 700)
    texts = [t for t in hard_texts() if t is None or len(t) < 3000][:90]
    texts, ids = texts + texts[:5] + [texts[7]] * 40, [*range(len(texts)), *range(5), *[None] * 40]
    from pyspark.sql import functions as F

    df = frame(spark, texts, ids).withColumn("pair", F.lit(1)).withColumn("stretch", F.lit("x")).withColumn("block", F.lit(0)).withColumn("copies", F.lit(9)).repartition(5)
    assert aligned_rows(df) == sorted(((i, *r) for i, r in zip(ids, brute_alignment(texts))), key=repr)


def test_vocabularies_are_read_once_and_links_carry_numbers(spark):
    import public_tokenizers
    from pyspark import cloudpickle

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert alignment._load(*paths) is alignment._load(*paths)

    def task():
        return alignment._load(*paths)

    load = alignment._load
    assert pickle.loads(cloudpickle.dumps(task))() is load(*paths)
    assert pickle.loads(cloudpickle.dumps(load)) is load  # the worker's own, with what it holds
    entries = spark.createDataFrame([(1, "x", [5, 5, 6], 3), (2, "y", [6], 1)], "s long, stretch string, links array<long>, n_links long")
    counts = spark.createDataFrame([(5, 9, True), (6, 2, False)], "pair long, docs long, best boolean")
    assert sorted(map(tuple, alignment.scores(entries, counts).select("s", "n_best", "count_sum").collect())) == [(1, 2, 20), (2, 0, 2)]


def test_alignment_of_nothing(spark):
    assert aligned_rows(spark.createDataFrame([], DOCS)) == []
    assert aligned_rows(frame(spark, [None, "", "▁"])) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


def test_alignment_refuses_other_vocabularies():
    import public_tokenizers

    with pytest.raises(ValueError):
        alignment._load(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment_of_the_documents_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]))), key=repr)
    assert sorted(map(tuple, alignment.query(spark, sf).select(COLUMNS).collect()), key=repr) == want


# ---- codes of vectors


def brute_lloyd(rows, rounds=6, entries=16, parts=8):
    """Every part against every entry in every round, in Python's integers: {vec_id: (code, error)} and the codebooks."""
    rows = [(i, [int(math.floor(4096 * x)) if abs(x) < 2**40 else heap_lloyd._floored(x) for x in v]) for i, v in rows]
    width = len(rows[0][1]) // parts
    cut = [(i, [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]) for i, v in rows]
    first = sorted(cut)[:entries]
    books = [[v[p] for _, v in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[0] for _, v in cut]
            for e in range(len(books[p])):
                of = [v[p] for (_, v), o in zip(cut, own) if o == e]
                if of:
                    books[p][e] = tuple(sum(c) // len(of) for c in zip(*of))
    found = [(i, [near(v[p], books[p]) for p in range(parts)]) for i, v in cut]
    return [(i, "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for i, f in found], [list(map(list, b)) for b in books]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize(("scale", "block"), [(1.0, 1024), (1.0, 13), (1e-3, 1024), (3e9, 1024)])
def test_codes(spark, monkeypatch, scale, block):
    monkeypatch.setattr(heap_lloyd, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 24))
    held = [(i, (scale * (centres[rng.integers(9)] + 0.2 * rng.normal(size=24))).tolist(), "xyz"[i % 3] if i % 7 else None) for i in range(150)]
    held += [(200 + i, held[3][1], "x") for i in range(60)]  # a hot vector
    bad = [(900, None, "x"), (901, [], "x"), (902, [1.0, None] * 12, "x"), (903, [float("nan")] * 24, "x"), (904, [float("inf")] + [0.0] * 23, None), (905, [float("-inf")] * 24, "y")]
    coded, books, compared = heap_lloyd.compress(vectors(spark, held + bad))
    got = sorted((r.vec_id, r.code, r.error) for r in coded.collect())
    want, want_books = brute_lloyd([(i, v) for i, v, _ in held])
    limit = 2**63
    assert got == sorted((i, c, e if e < limit else None) for i, c, e in want)
    assert books == want_books
    assert len(compared) == 7 and compared[0] == 8 * len(held) and compared[-1] <= compared[0]


def test_later_rounds_compare_few_parts(spark):
    rng = np.random.default_rng(5)
    centres = 4 * rng.normal(size=(16, 16))
    held = [(i, (centres[i % 16] + 0.1 * rng.normal(size=16)).tolist(), None) for i in range(2000)]
    _, _, compared = heap_lloyd.compress(vectors(spark, held))
    assert compared[0] == 16000 and sum(compared[1:]) < 0.2 * 6 * 16000


def test_codes_of_few_and_no_vectors(spark):
    assert heap_lloyd.compress(vectors(spark, []))[0].collect() == []
    assert heap_lloyd.compress(vectors(spark, [(1, None, "x"), (2, [], "x")]))[0].collect() == []
    coded, books, _ = heap_lloyd.compress(vectors(spark, [(7, [0.5] * 8, "x"), (7, [0.5] * 8, "x"), (None, [0.25] * 8, None)]))
    assert sorted((r.vec_id is None, r.code, r.error) for r in coded.collect()) == [(False, "00" * 8, 0), (False, "00" * 8, 0), (True, "02" * 8, 0)]
    assert len(books[0]) == 3


def test_label_errors(spark):
    from pyspark.sql import functions as F

    coded = spark.createDataFrame([(1, "a", "00", 5), (2, None, "00", 7), (3, None, "00", 1), (4, "", "00", 2), (5, "a", "00", None)], "vec_id long, label string, code string, error long")
    got = {r.vec_id: r.label_error for r in heap_lloyd.with_label_errors(coded).select("vec_id", "label_error").collect()}
    assert got == {1: 5, 5: 5, 2: 8, 3: 8, 4: 2}


def test_a_heap_gives_up_all_rows_that_the_drift_has_reached():
    rng = np.random.default_rng(2)
    heap, held, drift = heap_lloyd.Heap(), {}, 0.0
    for step in range(60):
        keys = rng.random(rng.integers(0, 9)) * 3 + drift
        names = np.arange(len(keys), dtype=np.int32) + 100 * step
        heap.push(keys, names)
        held.update(zip(names.tolist(), keys.tolist()))
        drift += rng.random() * 0.3
        out = set(heap.pop(drift).tolist())
        assert out == {n for n, k in held.items() if k <= drift}
        held = {n: k for n, k in held.items() if n not in out}


def test_codes_by_sql(spark, sf):
    got, want = oracle(spark, sf, "op12_heap_lloyd", heap_lloyd.query)
    assert got == want


# ---- mixing


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Clamp one round after the other until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in clamped]
        rest, every = total - sum(epochs * sizes[s] for s in clamped), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] > epochs * sizes[s] * every]
        if not over:
            return {s: float(epochs * sizes[s]) if s in clamped else (rest * weight[s] / every if every else 0.0) for s in order}
        clamped |= set(over)


def sources_frame(spark, seed, n_sources, n):
    rng = random.Random(seed)
    names = [None, "", "é", "Z", "a", "ab", "日"][:n_sources] + [f"s{i:03d}" for i in range(max(0, n_sources - 7))]
    rows = []
    for i in range(n):
        s = names[0] if rng.random() < 0.3 else rng.choice(names)
        rows.append((i, None if rng.random() < 0.05 else " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), None, s, None))
    return spark.createDataFrame(rows, DOCS), rows


@pytest.mark.parametrize(("seed", "n_sources", "n", "bucket"), [(1, 7, 300, 50_000), (2, 3, 200, 7), (3, 60, 500, 20), (4, 1, 20, 50_000)])
def test_mix(spark, monkeypatch, seed, n_sources, n, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    df, rows = sources_frame(spark, seed, n_sources, n)
    out = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sizes = collections.Counter()
    for i, _, _, s, _ in rows:
        sizes[s] += size[i]
    want = brute_targets(dict(sizes))
    assert sorted(r.doc_id for r in out) == list(range(n))
    taken = collections.Counter()
    for r in out:
        s = rows[r.doc_id][3]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(want[s], rel=1e-12, abs=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = {s: max(size[i] for i, _, _, t, _ in rows if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()))


def test_targets_reshare_what_clamped_sources_leave(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 5, "e": 300, None: 40}
    held = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(held).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert got["a"] == 3 and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_of_repeated_rows_words_and_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(5, "a b  c\td\x0be", None, "s", None)] * 9 + [(None, "x y z", None, None, None), (None, None, None, None, None), (6, "", None, "t", None)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "target")).collect()
    assert len(out) == 12 and [r.size for r in out if r.doc_id == 5] == [5] * 9
    assert sorted(r.size for r in out if r.doc_id is None) == [0, 2]
    assert all(r.taken <= 3 * r.size for r in out) and next(r for r in out if r.doc_id == 6).target == 0


def test_mix_by_sql(spark, sf):
    got, want = oracle(spark, sf, "op13_mixing", mixing.query)
    assert got == want


def test_mix_stays_on_the_jvm(spark, sf):
    plan = mixing.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
