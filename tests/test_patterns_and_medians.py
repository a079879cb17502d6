"""Many patterns at once, and medians by histograms, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import inspection, patterns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("most", "lot"), [(1_000_000, 16_000_000), (40, 16_000_000), (40, 300)])
def test_many_patterns(spark, rows, monkeypatch, most, lot):
    monkeypatch.setattr(patterns, "LOT_CHARACTERS", lot)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "aaaa"]
    asked = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(1, 6))) for _ in range(30)] + ["", None, "aa", "aa", "a", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3)
    wanted = spark.createDataFrame(list(enumerate(asked)), "item_id long, f string")
    got = patterns.containing(docs, wanted, most)
    assert rows(got) == sorted(((i, d) for i, f in enumerate(asked) for d, t in enumerate(texts) if f is not None and t is not None and f in t), key=repr)
    assert "NestedLoop" not in plan_of(got) and "CartesianProduct" not in plan_of(got)


def test_no_patterns_and_no_texts(spark):
    docs, wanted = (spark.createDataFrame([], s) for s in ("doc_id long, t string", "item_id long, f string"))
    assert patterns.containing(docs, wanted).collect() == []
    assert patterns.containing(spark.createDataFrame([(1, "a")], docs.schema), wanted).collect() == []
    assert patterns.containing(docs, spark.createDataFrame([(1, "a")], wanted.schema)).collect() == []


@pytest.mark.parametrize("few", [4096, 3])
def test_upper_medians(spark, monkeypatch, few):
    monkeypatch.setattr(inspection, "BUCKETS", 8)
    rng = random.Random(few)
    held = {"a": [rng.gauss(0, 1) for _ in range(301)], "b": [rng.expovariate(1) ** 9 for _ in range(200)], "c": [1.5] * 90, "d": [7.0], None: [float(rng.randrange(4)) for _ in range(50)], "e": [-1e308, 0.0, 1e308, 1e308, 5e-324]}
    df = spark.createDataFrame([(k, v) for k, x in held.items() for v in x] + [("a", None), ("f", None)], "k string, v double")
    got = {r["k"]: r["median"] for r in inspection.upper_median(df, "v", ["k"], few).collect()}
    assert got == {k: sorted(x)[len(x) // 2] for k, x in held.items()}
    every = [v for x in held.values() for v in x]
    assert inspection.upper_median(df, "v", few=few).collect()[0]["median"] == sorted(every)[len(every) // 2]
    assert inspection.upper_median(df.limit(0), "v", ["k"], few).collect() == []
    whole = inspection.upper_median(spark.range(1000).select((F.col("id") * 3).alias("v")), "v", few=few).collect()
    assert [r["median"] for r in whole] == [1500]


def test_languages_of_texts_that_taught_nothing(spark, sf):
    from siltstone.operators import languages

    docs = spark.read.parquet(f"{sf}/documents.parquet".replace("sf0.001", "sf0.01")).select("doc_id", F.col("text").alias("document"), "lang")
    model = languages.learn(docs.where("doc_id % 5 != 0"))
    held = docs.where("doc_id % 5 = 0 and lang is not null").withColumnRenamed("lang", "known").join(languages.guess(docs, model, "doc_id"), "doc_id")
    right, n = held.where("known = lang").count(), held.where("lang is not null").count()
    assert n > 20 and right >= 0.95 * n
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "xqzxqz wvkwvk zzxzzx")], "doc_id long, document string")
    assert {r["lang"] for r in languages.guess(odd, model, "doc_id").collect()} == {None}
    assert languages.guess(odd, languages.learn(docs.limit(0)), "doc_id").where("lang is not null").count() == 0


def test_fragments_are_located_in_changed_texts(spark, rows):
    from siltstone.operators import locating

    first, middle, last = "The quick brown fox jumps over the lazy dog once more. ", "Nothing of this stays as it is, whatever may happen to it. ", "In the end there is a sentence that everybody can find again."
    whole = first + middle + last
    texts = {
        1: "Intro. " + whole.replace(" ", "  \n"), 2: first + "something else entirely " + last, 3: "Only: " + last + " and more",
        4: "pre " + whole.replace("quick", "qu-\n  ick").replace("Nothing", "No-thing") + " post", 5: "ﬁnd the oﬃce", 6: "nothing at all", 7: None, 8: "", 9: "soft\u00adware is well-\nknown and semi-\nfinal",
    }
    asked = {1: whole, 2: "find the office", 3: " ", 4: None, 5: "software is wellknown", 6: "semi-final"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, t string")
    wanted = spark.createDataFrame(list(asked.items()), "item_id long, f string")
    got = {(r["item_id"], r["doc_id"]): (r["how"], texts[r["doc_id"]][r["begin"]: r["end"]]) for r in locating.located(docs, wanted).collect()}
    assert got == {
        (1, 1): ("exact", whole.replace(" ", "  \n")), (1, 2): ("edges", texts[2]), (1, 3): ("sentence", last), (1, 4): ("edges", texts[4][4:-5]),
        (2, 5): ("exact", "ﬁnd the oﬃce"), (5, 9): ("exact", "soft\u00adware is well-\nknown"), (6, 9): ("without_hyphens", "semi-\nfinal")}
    assert rows(locating.located(docs, wanted, 200)) == rows(locating.located(docs, wanted))


def test_places_are_noted_only_where_a_fragment_lies(monkeypatch):
    from siltstone.operators import locating

    rng = random.Random(3)
    letters = ["a", "b", " ", "\n", "\t", "-", "‐", "\u00ad", "ﬁ", "\u2003", "é"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(9)))
        assert [locating.plain(text, bare) for bare in (False, True)] == [locating.Plain(text, bare).value for bare in (False, True)], repr(text)
    held, made, whole = locating.Fragments([(7, "a fragment of some words")]), [], locating.Plain
    monkeypatch.setattr(locating, "Plain", lambda text, bare=False: made.append(text) or whole(text, bare))
    texts = ["nothing of it  here", "here\na  fragment of some  words", None, "", "- \u00ad a fragment of some words -"]
    assert [[f[:3] for f in held.found(t)] for t in texts] == [[], [(7, 5, 31)], [], [], [(7, 4, 28)]]
    assert made == [texts[1], texts[4]]
