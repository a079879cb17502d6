"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, bm25, bpe, common, compaction, fixity, graph, language, ngram_join, packing, substring_dedup, suffix_array, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', ',', '.', 'é'])}" for _ in range(n))


def sample_texts(seed=5):
    """Unrelated texts, exact and near copies, a shared passage, odd cases."""
    rng = random.Random(seed)
    passage = words(rng, 120)
    out = [words(rng, rng.randrange(5, 300)) for _ in range(25)]
    base = words(rng, 200).split()
    for _ in range(12):
        copy = base[:]
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    out += [words(rng, 40) + " " + passage + " " + words(rng, 60) for _ in range(6)]
    out += [out[0], out[0], None, "", " ", "one", "one two", "ONE  Two", "a b c d e", "a b c d e", "z" * 5000, "ab" * 3000, "é" * 900, "日本" * 700, words(rng, 4000)]
    return out


# ---- suffix arrays and repeated passages


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        b = bytes(rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(1, 60))) * rng.choice([1, 1, 3])
        want = sorted(range(len(b)), key=lambda i: b[i:])
        t = np.frombuffer(b, np.uint8)
        assert suffix_array.suffix_array(t, 256).tolist() == want
        lcp = suffix_array.permuted_lcp(t, np.array(want))
        for r in range(1, len(b)):
            x, y = b[want[r]:], b[want[r - 1]:]
            n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[want[r]] == n


def test_suffix_array_recurses_until_names_are_unique(monkeypatch):
    depths, sort = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t, sigma: depths.append(len(t)) or sort(t, sigma))
    rng = random.Random(2)
    part = bytes(rng.randrange(97, 123) for _ in range(300))
    b = b"".join(part + bytes([rng.randrange(97, 123)]) for _ in range(40))
    got = suffix_array.suffix_array(np.frombuffer(b, np.uint8), 256)
    assert got.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert len(depths) > 2 and all(2 * y <= x for x, y in zip(depths, depths[1:]))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i: i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                cover[i: i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1]))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_passages(spark, rows, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    texts = sample_texts()
    got = rows(substring_dedup.deduplicate(frame(spark, texts)))
    assert got == sorted(((i, *r) for i, r in enumerate(brute_repeats(texts, 400))), key=repr)


def test_repeated_passages_in_one_text_and_repeated_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 2000)
    rng = random.Random(8)
    p = words(rng, 150)
    texts = [p + words(rng, 900) + p, words(rng, 3000), "short", "short"]
    same = words(rng, 100)
    df = frame(spark, [*texts, same, same], [1, 2, None, None, 7, 7])
    want = brute_repeats([*texts, same, same], 400)
    assert rows(substring_dedup.deduplicate(df)) == sorted(((i, *r) for i, r in zip([1, 2, None, None, 7, 7], want)), key=repr)


@pytest.mark.parametrize(("group", "run"), [(4096, 4), (3, 4), (4096, 1)])
def test_repeated_passages_of_periodic_texts(spark, rows, monkeypatch, group, run):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "RUN", run)
    rng = random.Random(5)
    texts = ["ab" * 700, "abc" * 60 + words(rng, 20), "x" * 99, "x" * 101, words(rng, 30) + "-=" * 400 + words(rng, 30), "-=" * 90 + words(rng, 9)] + [words(rng, 15) + "12345678" * rng.randrange(10, 60) + words(rng, 5) for _ in range(8)]
    assert rows(substring_dedup.deduplicate(frame(spark, texts), 100, 25)) == sorted(((i, *r) for i, r in enumerate(brute_repeats(texts, 100))), key=repr)
    alone = texts[:1]
    assert rows(substring_dedup.deduplicate(frame(spark, alone), 100, 25)) == [(0, *brute_repeats(alone, 100)[0])]


@pytest.mark.parametrize("group", [1 << 19, 2])
def test_repeated_passages_leave_no_bytes_behind(spark, rows, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    made = []
    written = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    texts = sample_texts()
    found = substring_dedup.deduplicate(frame(spark, texts))
    there = [t for t in made if t.written_to in common._written]
    assert len(there) == 2 and not any("data" in t.columns for t in there)  # where pieces lie, and their runs
    assert rows(found) == sorted(((i, *r) for i, r in enumerate(brute_repeats(texts, 400))), key=repr)


def test_strip_repeats_keeps_rows_and_columns(spark):
    texts = sample_texts()
    out = substring_dedup.strip_repeats(frame(spark, texts).withColumn("spans", F.lit("mine")).withColumn("Key_A", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "Key_A"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and got[texts.index(None)]["text"] is None
    for i, (n, gone, _, digest) in enumerate(brute_repeats(texts, 400)):
        if not gone:
            assert got[i]["text"] == texts[i]
        elif texts[i].isascii():
            assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == digest and got[i]["n_chars"] == n - gone


# ---- near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("tile", "node", "frequent"), [(20_000, 8, 32), (3, 8, 2), (20_000, 2, 1)])
def test_ngram_join(spark, rows, monkeypatch, tile, node, frequent):
    for k, v in (("TILE", tile), ("NODE", node), ("FREQUENT", frequent)):
        monkeypatch.setattr(ngram_join, k, v)
    texts = sample_texts()
    got = rows(ngram_join.join(frame(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, *r) for i, r in enumerate(brute_components(texts))), key=repr)


@pytest.mark.parametrize("tile", [2_000_000, 700])
def test_ngram_join_counts_all_links(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", tile)
    texts = sample_texts()
    sets = [frozenset(s) for s in brute_sets(texts)]
    want = [(i, len({b for b in sets if a and b and a != b and 100 * len(a & b) >= 80 * len(a | b)})) for i, a in enumerate(sets)]
    assert max(n for _, n in want) > 3
    got = ngram_join.join(frame(spark, texts)).collect()
    assert sorted(((r["doc_id"], r["links"]) for r in got), key=repr) == sorted(want, key=repr)
    assert [(r["n_shingles"], r["component_id"]) for r in sorted(got)] == brute_components(texts)


@pytest.mark.parametrize("tile", [2_000_000, 700])
def test_keep_one_of_each_component(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", tile)
    texts = sample_texts()
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(frame(spark, texts)).collect())
    assert kept == [i for i, (n, c) in enumerate(brute_components(texts)) if not n or c == i]


def test_spanning_rows_never_exceed_members():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    edges = ngram_join.spanning(a, b)
    assert len(edges) < 300
    root = dict(edges.tolist())
    assert all(root.get(x, x) == root.get(y, y) for x, y in zip(a.tolist(), b.tolist()))


def test_related_with_and_without_counts():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64)) for _ in range(4)]
    sets = []
    for k in range(60):
        s = base[k % 4].copy()
        s[: rng.integers(0, 18)] += np.uint64(1 + k)
        sets.append(np.unique(s))
    full, links = ngram_join.related(sets, True)
    quick, _ = ngram_join.related(sets, False)
    same = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in set(x.tolist())}
    assert same(full) == same(quick)
    assert links.tolist() == [sum(i != j and ngram_join.linked(len(np.intersect1d(x, y)), len(x), len(y)) for j, y in enumerate(sets)) for i, x in enumerate(sets)]


def test_similarity_at_the_threshold(spark, rows):
    base = [f"a{i}" for i in range(49)]  # 45 shingles
    edge = base[:44] + [f"b{i}" for i in range(5)]  # 40 shared of 50: exactly 0.8
    below = base[:43] + [f"c{i}" for i in range(6)]
    got = dict((r[0], r[1]) for r in rows(ngram_join.join(frame(spark, [" ".join(base), " ".join(edge), " ".join(below)])), "doc_id", "component_id"))
    assert got == {0: 0, 1: 0, 2: 2}


def test_keep_one(spark, rows):
    texts = ["a b c d e f g", "A b c d e f g", "other text that stays here now", "", "", None, "a b c d e f g"]
    df = frame(spark, texts, [5, 3, None, 9, 9, 10, 3])
    kept = rows(ngram_join.keep_one(df), "doc_id", "text")
    assert len(kept) == 5 and [r for r in kept if r[0] in (3, 5)][0][0] == 3 and sum(r[0] == 9 for r in kept) == 2


def test_tree_bound_is_safe():
    rng = np.random.default_rng(2)
    points = rng.poisson(9, (300, ngram_join.GROUPS))
    points[150:] = points[:150] + rng.integers(-1, 2, (150, ngram_join.GROUPS)).clip(-points[:150])
    tree = ngram_join.Tree(points, np.arange(300))
    got = {pair for q, r in tree.search(points, np.arange(300)) for pair in zip(q.tolist(), r.tolist())}
    n = points.sum(1)
    for a in range(0, 300, 7):
        for b in range(300):
            if a != b and 5 * n[a] >= 4 * n[b] and 5 * n[b] >= 4 * n[a] and 9 * np.minimum(points[a], points[b]).sum() >= 4 * (n[a] + n[b]):
                assert (a, b) in got


def test_components(spark, rows):
    edges = [(i, i + 1) for i in range(40, 0, -1)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(1000, k) for k in range(1001, 1050)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 1 for i in range(1, 42)) and got[200] == got[150] == 100 and got[1049] == 1000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- tokens


def tokenizers_of(name):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path(name), Tokenizer.from_file(P.path(name))


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "  a", "a  b", "a\n\nb \n c", "don't we'll  I'm 'sx", "x<|endoftext|>y <|endoftext|> <|endof z", "ab" * 4000 + "  " * 900 + "q", " " * 5000 + "x", "é" * 3000 + "漢字" * 900, "²½ x² \x1c a", "İstanbul ΣΑΣ ǅ", "<|startoftext|>a"]
    parts = [" ", "  ", "\n", "a", "the", "'s", "'", "é", "1", ".", "<|", "|>", "<|endoftext|>", "\t", "漢", "Ä", "The,"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def test_transducer_equals_the_library():
    path, library = tokenizers_of("byte_bpe_50k.json")
    merges = bpe.Merges.load(path)
    assert 0 < merges.lookahead < 1000
    memo = bpe.WordMemo(merges)
    for t in odd_texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(memo.encode(t)), "<u4").tolist() == want
        for block in (1, 7):
            e = bpe.StreamEncoder(merges, block)
            ids = e.feed(t[: len(t) // 2]) + e.feed(t[len(t) // 2:]) + e.finish()
            assert ids == want
        back = bpe.ByteToText(merges)
        assert "".join(back.feed([i]) for i in want) + back.finish() == library.decode(want, skip_special_tokens=False) == t


def test_lookahead_on_random_merge_lists():
    rng = random.Random(4)
    for _ in range(60):
        tokens, pairs = {i: bytes([97 + i]) for i in range(3)}, []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
            if all((a, b) != p[:2] for p in pairs) and tokens[a] + tokens[b] not in tokens.values():
                pairs.append((a, b, len(tokens)))
                tokens[len(tokens)] = tokens[a] + tokens[b]
        merges = bpe.Merges(tokens, pairs)
        for _ in range(20):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 200)))
            whole = merges.merge(data)
            assert whole == merges._merge_long([merges.first[c] for c in data])
            t = bpe.Transducer(merges, block=5)
            assert t.feed(data) + t.finish() == whole


def test_words_are_merged_together(monkeypatch):
    path, library = tokenizers_of("byte_bpe_50k.json")
    merges = bpe.Merges.load(path)
    memo = bpe.WordMemo.of(merges)
    assert memo is bpe.WordMemo.of(merges)  # the worker's next task finds it
    rng = random.Random(5)
    letters = "abcdeéßnrst漢,.\n1*"
    texts = odd_texts() + [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(300))]
    short = [w.encode() for t in texts for w in t.split(" ") if len(w.encode()) <= bpe.SHORT]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.merge_many(short)] == [merges.merge(x) for x in short]
    assert merges.merge_many([]) == [] and merges.merge_many([b""]) == [b""]
    memo.learn(texts)
    calls, alone = [], merges.merge
    monkeypatch.setattr(merges, "merge", lambda data: calls.append(data) or alone(data))
    for t in texts:
        assert np.frombuffer(b"".join(memo.encode(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    before, plain = len(calls), [w for w in texts[-1].split(" ") if not w[0].isspace() and not w[-1].isspace()]
    b"".join(memo.encode(" ".join(["x", *plain])))
    assert len(calls) - before <= 2  # the first word alone


def test_encode_documents(spark, rows):
    path, library = tokenizers_of("byte_bpe_50k.json")
    texts = [None, *odd_texts()[:40]]
    got = rows(bpe.encode_documents(frame(spark, texts), path))
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


# ---- packing


def test_texts_are_coded_in_bounded_memory(monkeypatch):
    import tracemalloc

    path, library = tokenizers_of("byte_bpe_50k.json")
    memo = bpe.WordMemo(bpe.Merges.load(path))
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(500_000))
    want = library.encode(run, add_special_tokens=False).ids
    tracemalloc.start()
    digest, n = hashlib.sha256(), 0
    for part in memo.encode(run):
        digest.update(part)
        n += len(part) // 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(want) and digest.hexdigest() == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert peak < 4_000_000 < 36 * n  # all ids as a list would take more
    monkeypatch.setattr(bpe, "PART", 60)
    for t in [*odd_texts(), words(rng, 500), "a  b c   d " * 40, "x" * 100 + " y"]:
        assert np.frombuffer(b"".join(memo.encode(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_fill_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        used = packing.fill(counts, room)
        assert sum(used) == max(sums) and all(used.count(k) <= counts[k] for k in used)


def test_plan_packs_all_and_tightly():
    rng = random.Random(7)
    histogram = collections.Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000))
    bins = packing.plan(dict(histogram))
    back = collections.Counter()
    for times, lengths in bins:
        assert sum(lengths) <= 4096
        for k in lengths:
            back[k] += times
    assert back == histogram
    assert sum(t for t, _ in bins) <= -(-sum(k * n for k, n in histogram.items()) // 4096) + 1


def test_words_with_marks_at_their_end(monkeypatch):
    path, library = tokenizers_of("word_bpe_49k.json")
    memo = packing.WordIds(path)
    for word in ["İ.", "İ", "ones,###", "it's.", "x''.", "ß!!", "日本.", "a-b.", "..a..", "<|endoftext|>", "a<|endoftext|>", "a1.", "don't!", "a's,", "ŉ,"]:
        assert memo.encode(word) == struct.pack(f"<{len(ids := library.encode(word, add_special_tokens=False).ids)}I", *ids), word
    memo.clear()
    asked = []
    monkeypatch.setattr(memo, "tokenizer", type("Counting", (), {"encode": lambda self, word, **k: asked.append(word) or library.encode(word, **k)})())
    memo.encode("ones ones,### ones.### ones!!")
    assert sorted(asked) == ["!!", ",###", ".###"]  # a word is coded once whatever ends it


def test_memo_of_words_is_bounded_and_keeps_frequent_ones(monkeypatch):
    path, library = tokenizers_of("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHED", 20)
    memo, coded = packing.WordIds(path), []
    plain = memo.plain
    memo.plain = lambda letters: coded.append(letters) or plain(letters)
    for i in range(500):
        text = "often " + "".join(chr(97 + int(c)) for c in str(i))
        assert memo.encode(text) == struct.pack(f"<{len(ids := library.encode(text, add_special_tokens=False).ids)}I", *ids)
        assert len(memo) <= 20 and len(memo.older) <= 20
    assert coded.count("often") == 1


def test_a_text_goes_to_the_tasks_once(spark):
    docs = frame(spark, ["a" * 500, None])
    row = substring_dedup._with_spans(docs, 400, 64).schema["row"].dataType
    assert row["text"].dataType.typeName() == "boolean"  # not the text again
    assert sorted((r["doc_id"], r["text"]) for r in substring_dedup.strip_repeats(docs).collect()) == [(0, ""), (1, None)]


def test_settings_of_a_written_table_are_put_back(spark):
    before = spark.conf.get(RECORDS := "spark.sql.execution.arrow.maxRecordsPerBatch")
    common.written(spark.range(3), "three", **common.FEW_ROWS)
    assert spark.conf.get(RECORDS) == before


@pytest.mark.parametrize("bucket", [50_000, 5])
def test_pack_documents(spark, monkeypatch, bucket):
    path, library = tokenizers_of("word_bpe_49k.json")
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", bucket)
    texts = [None, *sample_texts(), *odd_texts()[:30], *sample_texts()[:5]]
    got = packing.pack_documents(frame(spark, texts), path, 512).collect()
    pieces, bins = {}, collections.defaultdict(list)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, lo in enumerate(range(0, len(ids), 512)):
            part = ids[lo: lo + 512]
            pieces[i, p] = (lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(v[1] for v in pieces.values()) // 512) + 1


# ---- languages


def language_docs(spark, n=120):
    rng = random.Random(2)
    letters = {"xx": "abcde", "yy": "vwxyz", "zz": "éàüßñ"}
    data = [(i, " ".join("".join(rng.choice(s) for _ in range(4)) for _ in range(30)), lang, "s", 0) for i in range(n) for lang, s in [list(letters.items())[i % 3]]]
    odd = [(n, None, "xx", "s", 0), (n + 1, "123 !?", "xx", "s", 0), (n + 2, "", None, "s", 0), (None, "abcd bcda", "xx", "s", 0), (n + 3, "ABCD DCBA " * 3000, None, "s", 0)]
    return spark.createDataFrame(data + odd, DOCS), n


def test_language(spark):
    df, n = language_docs(spark)
    profiles = language.fit(df)
    assert profiles.langs == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r for r in language.identify(df, profiles, keep=["doc_id", "lang"]).collect()}
    assert all(got[i]["lang_pred"] == got[i]["lang"] for i in range(n))
    assert [got[k]["lang_pred"] for k in (n, n + 1, n + 2)] == ["und"] * 3 and got[n + 3]["lang_pred"] == "xx" and got[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_by_brute_force(spark, monkeypatch):
    """Profiles and distances by plain dictionaries, with all letters told apart."""
    monkeypatch.setattr(language, "PROFILE", 40)
    df, n = language_docs(spark)
    data = df.collect()
    learned = [r for r in data if r["lang"] and r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    alphabet = sorted({c for r in learned for c in r["text"].lower() if c.isalpha()})

    def grams(text):
        c = [alphabet.index(x) + 1 if x in alphabet else len(alphabet) + 1 if x.isalpha() else 0 for x in (text[k].lower() if len(text[k].lower()) == 1 else text[k] for k in range(len(text)))]
        c, a = [0, *c, 0], len(alphabet) + 2
        out = collections.Counter(x for x in c if x)
        out.update(a + x * a + y for x, y in zip(c, c[1:]) if x or y)
        out.update(a + a * a + (x * a + y) * a + z for x, y, z in zip(c, c[1:], c[2:]) if y)
        return out

    def first(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:40]]

    totals = collections.defaultdict(collections.Counter)
    for r in learned:
        totals[r["lang"]].update(grams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(first(c))} for lang, c in totals.items()}
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df, 40)).collect()}
    for r in data:
        own = first(grams(r["text"] or ""))
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0)
            continue
        distance = {lang: sum(abs(p.get(g, 40) - i) for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - (1 - distance[best] / (40 * len(own)))) < 1e-12


def test_language_of_held_out_documents(spark):
    out = language.query(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    right = out.join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.99


def test_language_replaces_columns_of_its_names(spark):
    df, _ = language_docs(spark)
    df = df.withColumn("Lang_Pred", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = language.identify(df, language.fit(df))
    assert out.columns == [c for c in df.columns if c != "Lang_Pred"] + ["lang_pred", "score"]
    assert out.where("lang_pred = 'xx'").count()


def test_language_learns_only_from_its_fold(spark):
    df, n = language_docs(spark)
    held = df.where(language.held_out(F.col("doc_id"))).select("doc_id")
    assert {r[0] for r in held.collect()} == {None} | {i for i in range(n + 4) if zlib.crc32(str(i).encode()) % 5 == 0}
    nothing = df.where(language.held_out(F.col("doc_id")))
    out = language.identify(nothing.select("doc_id", "text"), language.fit(nothing)).collect()
    assert {r["lang_pred"] for r in out} == {"und"}


# ---- search


def test_bm25(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_WORDS", 800)
    monkeypatch.setattr(bm25, "RANGE", 4)
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(3, 120), 60).lower() for _ in range(90)] + [None, "", "!!", "w1 w1 w1", "w1 w1 w1"]
    df = frame(spark, texts)
    index = bm25.build_index(df)
    assert index.count() > 2
    toks = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(LOWER)) for t in texts]
    tf = [collections.Counter(t) for t in toks]
    frequency = collections.Counter(w for c in tf for w in c)
    n, mean = len(texts), sum(map(len, toks)) / len(texts)
    idf = {w: np.log1p((n - k + 0.5) / (k + 0.5)) for w, k in frequency.items()}
    asked = spark.createDataFrame([(i, texts[i]) for i in range(0, 90, 10)], "doc_id long, text string")
    terms = bm25.term_counts(asked).join(bm25.document_frequencies(index), "term").select("query_id", "term", bm25.idf(F.col("df"), F.lit(n)).alias("idf"))
    got = collections.defaultdict(list)
    for r in bm25.search(index, terms, 7).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for q in range(0, 90, 10):
        score = {d: sum(idf[w] * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * len(toks[d]) / mean)) for w in tf[q] if w in tf[d]) for d in range(n) if d != q}
        want = sorted(((-round(s, 9), d) for d, s in score.items() if s > 0))[:7]
        assert [(d, pytest.approx(-s)) for s, d in want] == [(d, s) for _, d, s in sorted(got[q])]


def test_bm25_queries_go_through_the_blocks_together(spark, monkeypatch):
    monkeypatch.setattr(bm25, "CELLS", 4000)
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 90), 70).lower() for _ in range(150)] + [None, "", "w1 w1", "w1 w1"] + ["w2 w3 w4 w5"] * 30
    df = frame(spark, texts)
    index = bm25.build_index(df.coalesce(1))
    for rare in (2, 16, 1000):  # few lists are common, or all
        monkeypatch.setattr(bm25, "COMMON", rare)
        terms = bm25.query_terms(bm25.term_counts(df.where("doc_id % 3 = 0")), bm25.document_frequencies(index), len(texts)).collect()
        idf = {np.int64(r["term"]).view(np.uint64): r["idf"] for r in terms}
        asked = np.array(sorted(idf), np.uint64)
        by_query = collections.defaultdict(list)
        for r in terms:
            by_query[r["query_id"]].append(np.int64(r["term"]).view(np.uint64))
        queries = [(q, np.array(sorted(t), np.uint64)) for q, t in by_query.items()]
        for row in index.collect():
            shard = bm25.Shard(row.asDict(), 40.0, asked, np.array([idf[t] for t in asked]))
            assert shard.blocks == 3
            alone = [shard.search(q, t, 7) for q, t in queries]
            monkeypatch.setattr(shard, "search", None)  # none goes alone
            for (ids, scores), (want, best) in zip(shard.search_many(queries, [0.0] * len(queries), 7), alone):
                assert ids.tolist() == want.tolist() and scores.tolist() == best.tolist()
            beaten = [s[len(s) // 2] if len(s) else 0.0 for _, s in alone]
            for (ids, scores), (want, best), least in zip(shard.search_many(queries, beaten, 7), alone, beaten):
                assert [x for x in zip(ids, scores) if x[1] >= least] == [x for x in zip(want, best) if x[1] >= least]
    # where rows share ids each still comes once
    twice = df.unionByName(df.where("doc_id < 20")).coalesce(1)
    found = bm25.search_by_document(twice, df.where("doc_id < 9")).collect()
    assert len({(r["query_id"], r["doc_id"]) for r in found}) == len(found) == 90


def test_bm25_shards_are_read_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_WORDS", 50)
    monkeypatch.setattr(bm25, "SLICE", 200)
    rng = random.Random(4)
    df = frame(spark, [words(rng, 30, 40).lower() for _ in range(60)]).coalesce(1)
    index = bm25.build_index(df)
    assert index.count() > 5 and index.select(F.input_file_name()).distinct().count() == index.count()
    assert len(index.first()["tf"]) == np.frombuffer(index.first()["start"], np.uint32)[-1]  # a byte a count
    for most in (0, 255, 256, 65_536):
        a = np.array([most, 0, most // 2], np.uint32)
        assert bm25.widths(bm25.narrowed(a).tobytes(), 3).tolist() == a.tolist()
    assert bm25.widths(b"", 0).tolist() == []


def test_bm25_by_document_and_empty(spark):
    df = frame(spark, ["a b c"] * 6 + ["d e"] * 6)
    got = bm25.search_by_document(df, df.where("doc_id in (0, 6)"), 3)
    assert sorted((r["query_id"], r["doc_id"]) for r in got.collect()) == [(0, 1), (0, 2), (0, 3), (6, 7), (6, 8), (6, 9)]
    none = frame(spark, [])
    assert bm25.search_by_document(none, none).count() == 0


def test_bm25_asks_with_every_term(spark):
    few = spark.createDataFrame([(0, "quartz lamp"), (1, "quartz lamp"), (2, "other words")], "doc_id long, text string")
    assert [r["doc_id"] for r in bm25.search_by_document(few, few.where("doc_id = 0")).collect()] == [1]
    # 40 terms in six documents and, by score first, one term that two documents share alone
    many = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, many) for i in range(1, 6)] + [(0, many + " rare"), (6, "rare")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25.search_by_document(df, df.where("doc_id = 0")).collect()}
    mean = (5 * 40 + 41 + 1) / 7
    weigh = lambda df, n: np.log1p((7 - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / mean))
    assert got.keys() == {1, 2, 3, 4, 5, 6}
    assert abs(got[6] - weigh(2, 1)) < 1e-9 and abs(got[1] - 40 * weigh(6, 40)) < 1e-9


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 10))
    x[100] = x[101]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 10), (602, [float("nan")] + [1.0] * 9), (603, [None] + [1.0] * 9), (604, [1.0, 2.0]), (None, [1.0] * 10), (5, x[5].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index, books = ann.build_index(df)
    assert index.count() == 602 and set(books) == {2, 10}
    asked = index.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    got = collections.defaultdict(list)
    for r in ann.search(index, books, asked, 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits >= 0.9 * 300 and set(got) == set(range(0, 600, 20))


def test_ann_more_copies_than_are_scored_first(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    x[rng.permutation(1500)[:700]] = x[0]  # equal vectors have equal codes
    near = rng.permutation(1500)[:500]
    x[near] = x[1] + rng.normal(size=(500, 12)) * 1e-3  # and so have many of these
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(1)
    index, books = ann.build_index(df)
    asked = [0, 1, int(near[7])]
    got = collections.defaultdict(list)
    for r in ann.search(index, books, index.where(F.col("vec_id").isin(asked)).select("vec_id", "embedding")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    for q in asked:
        score = (x * x[q]).sum(1)
        assert [v for _, v in sorted(got[q])] == [i for i in np.lexsort((np.arange(1500), -score)).tolist() if i != q][:20]


def test_ann_dimensions_ties_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0, 1.0]), (7, [2.0, 0.0]), (5, [2.0, 0.0]), (8, [0.5] * 3), (40, [1.0] * 3000), (41, [2.0] * 3000), (60, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.unionByName(df).withColumn("code", F.lit(1)).withColumn("DIM", F.lit("x")).withColumn("score", F.lit(None))
    index, books = ann.build_index(df)
    asked = index.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(index, books, asked).collect())
    assert got == [(0, 1, 5, 2.0), (0, 2, 7, 2.0), (20, 1, 8, 1.0), (40, 1, 41, 6000.0)]


@pytest.mark.parametrize("block", [4096, 7])
def test_ann_recall_on_the_embeddings_table(spark, sf, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], float)
    got = {(r["query_id"], r["vec_id"]) for r in ann.query(spark, sf).collect()}
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x * x[i]).sum(1))) if j != i][:20]
        want |= {(ids[i], ids[j]) for j in order}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_ann_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    index, books = ann.build_index(df)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(index, books, index.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    index, books = ann.build_index(df.limit(0))
    assert ann.search(index, books, index.select("vec_id", "embedding")).count() == 0


def test_anisotropic_codes_favour_the_parallel_error(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel():
        books = ann.fit(x, 4)
        r = x - books[np.arange(32), ann.assign(x, books)].reshape(600, -1)
        return ((r * x).sum(1) ** 2).mean()

    aware = parallel()
    monkeypatch.setattr(ann, "eta", lambda dim: 1.0)
    assert aware < 0.8 * parallel()


# ---- urls, fixity, compaction


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fit = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"


def test_url_filter(spark, rows):
    urls = [None, "", "nothing", "http://", "http://org", "http://ORG/", "http://a.b.org/x", "http://xorg/", "http://example.org/es/1", "https://M.Example.org/en/17?x#y", "http://example.org/en", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/de", "http://x.com:80/fr/", "http://com/fr/http://y.org/", "http://..org/", "x://org/?://b", "http://é.com/de/ü\nx"]
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(urls)] + [(None, "http://a.org/", None, None)] * 2, "page_id long, url string, html string, host string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    want = sorted([(i, *brute_url(u)) for i, u in enumerate(urls)] + [(None, *brute_url("http://a.org/"))] * 2, key=repr)
    assert rows(url_filter.filter_urls(pages, rules)) == want
    assert rows(url_filter.filter_urls(pages, rules.limit(0)), "verdict") == [("allow",)] * len(want)


def test_fixity(spark, rows):
    a = spark.createDataFrame([(i, f"u{i}", "x" * (i % 50) * 100) for i in range(1500)] + [(3, "again", "y"), (None, "n", None)], "page_id long, url string, html string")
    assert fixity.audit(a, a.repartition(5), "page_id", ["url", "html"]).count() == 0
    b = a.withColumn("html", F.when(F.col("page_id") == 700, "damage").otherwise(F.col("html"))).where("page_id is null or page_id != 1200").unionByName(spark.createDataFrame([(9999, "e", "e")], a.schema))
    got = rows(fixity.audit(a, b, "page_id", ["url", "html"]), "record_id", "damage", "archive")
    assert got == [(1200, "missing", 2), (700, "changed", 1), (9999, "extra", None)]
    empty = a.limit(0)
    assert fixity.audit(empty, empty, "page_id", ["url", "html"]).count() == 0
    assert fixity.audit(empty, a.limit(3), "page_id", ["url", "html"]).count() == 3


def test_fixity_of_repeated_and_missing_ids(spark, rows):
    schema = "page_id long, url string, html string, archive string"
    a = spark.createDataFrame([(5, "a", "m", "x"), (6, "b", "b", "x"), (6, "b", "b", "x"), (None, "n", None, "x"), (None, "o", "", "x"), (8, None, None, "x"), (9, "z" * 100_000, "y", "x")], schema)
    audit = lambda b: rows(fixity.audit(a, b, "page_id", ["url", "html"]), "record_id", "damage", "offset")
    assert audit(a.unionByName(spark.createDataFrame([(5, "a", "a", "x")], schema))) == [(5, "extra", None)]
    assert audit(a.where("page_id is null or page_id != 6").unionByName(a.where("page_id = 6").limit(1))) == [(6, "missing", 6)]
    assert audit(a.withColumn("url", F.when(F.col("page_id") == 5, "longer than before").otherwise(F.col("url")))) == [(5, "changed", 0)]
    assert audit(a.withColumn("url", F.when(F.col("url") == "n", "N").otherwise(F.col("url")))) == [(None, "extra", None), (None, "missing", None)]
    assert audit(a.where("page_id is null or page_id < 9")) == [(9, "missing", 10)]


def test_fixity_reads_only_differing_ranges(spark):
    a = spark.createDataFrame([(i, f"u{i}") for i in range(4000)], "page_id long, url string")
    b = a.withColumn("url", F.when(F.col("page_id") == 777, "a longer text").otherwise(F.col("url")))
    x, y = (fixity.tree(fixity.records(t, "page_id", ["url"])) for t in (a, b))
    assert [(r["archive"], r["range"]) for r in fixity.damaged_ranges(x, y).collect()] == [(777 // 512, 777 % 512 // 16)]


def test_compaction_round_trip(spark, rows):
    df = frame(spark, sample_texts() * 4, [*range(len(sample_texts()) * 4 - 2), None, 1]).withColumn("shard", F.lit("own")).withColumn("Tier", F.lit(1))
    got = compaction.compacted(df, 10, 40_000)
    assert rows(got, "doc_id", "n_bytes", "text_sha256") == rows(df.select("doc_id", F.octet_length("text").cast("long"), F.sha2("text", 256)))
    assert 1 < got.select("shard").distinct().count() < 20
    assert compaction.compacted(df.limit(0)).count() == 0


def simulated_store(sizes, target):
    """(order, tier) of the shard that each arrival of so many bytes ends in."""
    tier = lambda n: next(k for k in range(60) if n <= compaction.TIER_BASE * 4**k)
    shards = [(k, n, [k]) for k, n in enumerate(sizes)]
    while True:
        merged, gone = [], set()
        for level in sorted({tier(n) for _, n, _ in shards}):
            runs = [s for s in sorted(shards) if tier(s[1]) == level and s[1] < target / 2]
            if len(runs) < compaction.LEAST_RUNS:
                continue
            group = []
            for s in runs:
                if group and sum(x[1] for x in group) + s[1] > target:
                    merged.append(group)
                    group = []
                group.append(s)
            merged.append(group)
        merged = [g for g in merged if len(g) > 1]
        if not merged:
            return {a: (k, tier(n)) for k, n, held in shards for a in held}
        for g in merged:
            gone |= {s[0] for s in g}
        shards = [s for s in shards if s[0] not in gone] + [(g[0][0], sum(s[1] for s in g), [a for s in g for a in s[2]]) for g in merged]


@pytest.mark.parametrize("target", [9_000, 60_000])
def test_compaction_places_rows_by_size_tiers(spark, monkeypatch, target):
    monkeypatch.setattr(compaction, "TIER_BASE", 1_000)
    rng = random.Random(12)
    texts = [rng.choice([None, "", "x" * rng.randrange(1, 900)]) for _ in range(400)]
    sizes = [sum(len(t or "") + 1 for t in texts[k: k + 10]) for k in range(0, 400, 10)]  # a source of one byte each
    want = simulated_store(sizes, target)
    got = compaction.compacted(frame(spark, texts), 10, target).collect()
    assert sorted((r["doc_id"], r["shard"], r["tier"]) for r in got) == [(i, *want[i // 10]) for i in range(400)]
    assert len({r["shard"] for r in got}) < 40


def test_each_merged_file_has_its_task(spark, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path))
    store.append(frame(spark, ["t" * 100] * 40), F.col("doc_id"))
    groups = compaction.merges(store.manifest()["shards"], 1000)
    spark.conf.set(compaction.UNION, "false")
    try:
        assert len(groups) > 3 and store._one_task_each(groups, "shard").rdd.getNumPartitions() == len(groups)
    finally:
        spark.conf.set(compaction.UNION, "true")
    merged = store._merge(groups)
    assert all(len(list((tmp_path / "data" / s["shard"]).glob("*.parquet"))) == 1 for s in merged)
    # a task's files carry its number
    assert len({f.name.split("-")[1] for s in merged for f in (tmp_path / "data" / s["shard"]).glob("*.parquet")}) == len(groups)


def test_store_versions(spark, rows, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path))
    for i in range(5):
        store.append(frame(spark, [f"text {i}"], [i]))
    before = store.manifest()
    assert before["version"] == 5 and store.compact() == 1 and store.version() == 6
    assert len(store.manifest()["shards"]) == 1 and rows(store.read(), "doc_id") == rows(store.read(5), "doc_id") == [(i,) for i in range(5)]
    with pytest.raises(Exception, match="(?i)exist"):  # another writer was faster
        store.commit(before, before["schema"], [])
    assert store.version() == 6
    store.vacuum()
    assert store.read().count() == 5


def test_merges_by_tier():
    shards = [{"shard": str(i), "order": i, "bytes": b, "rows": 1} for i, b in enumerate([5, 6, 900_000_000, 7, 8, 9, 30_000_000, 30_000_000, 30_000_000, 30_000_000, 30_000_000])]
    groups = [[int(s["shard"]) for s in g] for g in compaction.merges(shards)]
    assert groups == [[0, 1, 3, 4, 5], [6, 7, 8, 9]]


# ---- empty tables and the pipeline


def test_empty_documents(spark):
    none = frame(spark, [])
    assert substring_dedup.deduplicate(none).count() == 0
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    assert bpe.encode_documents(none, tokenizers_of("byte_bpe_50k.json")[0]).count() == 0
    assert packing.pack_documents(none, tokenizers_of("word_bpe_49k.json")[0]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).count() == 0
    assert language.identify(none, language.fit(none)).count() == 0


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", None, "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [i for i in sorted(texts) if i < 900_000]
    part = brute_components([texts[i] for i in kept])
    firsts = [i for k, i in enumerate(kept) if not part[k][0] or part[k][1] == k]
    stage = P.STAGES[1][1](spark, P.STAGES[0][1](spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(r["doc_id"] for r in stage.collect()) == firsts and stage.columns == docs.columns
    path, library = tokenizers_of("word_bpe_49k.json")
    want = {}
    data = [texts[i].encode() for i in firsts]
    size = P.PASSAGE_BYTES
    seen = collections.Counter(b[i: i + size] for b in data for i in range(len(b) - size + 1))
    for d, b in zip(firsts, data):
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i: i + size]] > 1:
                cover[i: i + size] = b"\1" * size
        left = bytes(x for x, c in zip(b, cover) if not c).decode("utf-8", "ignore")
        want[d] = len(library.encode(left, add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in P.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
