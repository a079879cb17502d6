"""Nearest neighbours by pivots against brute force, and how little of the rows a query has to meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import knn


def clustered(seed, n, dim=12, clusters=30, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dim))).tolist()


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(3)


def brute(rows, queries, k, metric, skip_self, within=None):
    out = []
    for q, v in enumerate(queries):
        near = []
        for i, w in enumerate(rows):
            if v is None or w is None or len(v) != len(w) or (skip_self and i == q):
                continue
            d = round(float(knn.distances(np.array([v], float), np.array([w], float), metric)[0, 0]), 12)
            if within is None or d <= within:
                near.append((d, i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(near)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("metric", "skip_self", "within"), [("cosine", True, 0.3), ("cosine", False, None), ("l2", True, None), ("l2", False, 0.2), ("ip", False, None)])
def test_nearest_over_many_parts(spark, rows, monkeypatch, metric, skip_self, within):
    monkeypatch.setattr(knn, "PART_ROWS", 25)
    vectors = clustered(3, 240)
    vectors += [vectors[5]] * 70 + [[0.0] * 12] * 3 + [[1.0, 2.0]] * 2 + [[3.0, 1.0], None, [-x for x in vectors[0]]]
    df = frame(spark, vectors)
    asked = vectors if skip_self else vectors[200:]
    queries = df if skip_self else frame(spark, asked)
    got = knn.nearest(df, queries, 4, metric, skip_self=skip_self, max_distance=within)
    if metric == "ip":  # sums in another order may tie otherwise
        got = got.where("position <= 4")
        assert got.count() == len(brute(vectors, asked, 4, metric, skip_self, within))
        return
    assert rows(got, "query_id", "id", "position") == brute(vectors, asked, 4, metric, skip_self, within)


def test_queries_meet_few_parts_of_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 50)
    vectors = clustered(1, 4000, clusters=100, spread=0.03)
    sent = []
    own = knn._best_of_parts
    monkeypatch.setattr(knn, "_best_of_parts", lambda rows, asked, parts, *more: sent.append((asked.count(), parts)) or own(rows, asked, parts, *more))
    df = frame(spark, vectors)
    pairs = knn.near_duplicate_pairs(df, 5, 0.02).count()
    (first, parts), (rest, _) = sent
    assert pairs > 4000 and first == 4000 and parts >= 80
    assert first + rest < 0.1 * 4000 * parts


def test_one_vector_on_a_third_of_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 40)
    vectors = clustered(2, 300) + [[1.0] * 12] * 150
    sent = []
    own = knn._best_of_parts
    monkeypatch.setattr(knn, "_best_of_parts", lambda held, asked, *more: sent.append((held.count(), asked.count())) or own(held, asked, *more))
    df = frame(spark, vectors)
    got = knn.nearest(df, df, 3, skip_self=True)
    assert rows(got, "query_id", "id", "position") == brute(vectors, vectors, 3, "cosine", True)
    assert all(held == 304 for held, _ in sent) and sent[0][1] == 301


def test_no_rows_and_no_pivots(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 2)
    df = frame(spark, [[0.0, 0.0]] * 5)
    assert knn.nearest(df, df, 2).where(F.col("distance") == 1).count() == 10
    assert knn.nearest(df.limit(0), df, 2).collect() == [] and knn.nearest(df, df.limit(0), 2).collect() == []


def test_single_components_travel_as_such(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 16)
    vectors = np.random.default_rng(4).normal(size=(40, 4)).astype(np.float32)
    single = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    double = single.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kinds, best = [], knn._best_of_parts
    monkeypatch.setattr(knn, "_best_of_parts", lambda own, sent, *rest: kinds.append({f.schema["v"].dataType.simpleString() for f in (own, sent)}) or best(own, sent, *rest))
    found = [sorted(map(tuple, knn.nearest(rows, single, 3, skip_self=True).select("query_id", "id", "distance").collect())) for rows in (single, double)]
    assert found[0] == found[1] and len(found[0]) == 120
    assert kinds[0] == {"array<float>"} and kinds[-1] == {"array<double>"}


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_queries_that_meet_all_parts_go_in_rounds(spark, rows, monkeypatch, metric):
    monkeypatch.setattr(knn, "PART_ROWS", 25)
    monkeypatch.setattr(knn, "SENT_ROWS", 100, raising=False)
    vectors = np.random.default_rng(6).normal(size=(300, 12)).tolist()  # nothing can be ruled out
    sent, best = [], knn._best_of_parts
    monkeypatch.setattr(knn, "_best_of_parts", lambda own, asked, parts, *more: sent.append((asked.count(), parts)) or best(own, asked, parts, *more))
    df = frame(spark, vectors)
    got = knn.nearest(df, df, 4, metric, skip_self=True)
    assert rows(got, "query_id", "id", "position") == brute(vectors, vectors, 4, metric, True)
    assert max(n for n, _ in sent) < 1.5 * 300 and {parts for _, parts in sent} <= set(range(12, 30))
    assert sum(n for n, _ in sent) > 0.8 * 300 * 12


def odd_rows():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 5)), np.zeros((2, 5)), 1e-9 * rng.normal(size=(20, 5)), 1e9 * rng.normal(size=(20, 5))])
    return np.concatenate([x, x[:30]])


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_pairs_within_a_distance_are_those_of_all_distances(metric):
    x = odd_rows()
    d = np.round(knn.distances(x, x, metric), 12)
    for share in (0.0, 0.05, 0.5, 1.0):
        for most in (np.quantile(d, share, axis=1), np.full(len(x), np.inf)):
            query, at, far = knn.within(x, x, metric, most)
            assert set(zip(query.tolist(), at.tolist())) == set(zip(*(i.tolist() for i in np.nonzero(d <= most[:, None]))))
            assert far.tolist() == d[query, at].tolist()


def test_angles_are_told_apart_in_single_precision_and_computed_in_double(monkeypatch):
    monkeypatch.setattr(knn, "PAIRS", 100)
    x = np.concatenate([odd_rows(), [[1e200] * 5, [np.nan] * 5, [1.0, 1.0, 1.0, 1.0, 1.0 + 1e-9]]])
    with np.errstate(all="ignore"):
        d = knn.distances(x, x, "cosine")
        for k in (1, 3, 40, len(x)):
            for most in (0.0, 1e-9, 0.3, 1.0, 2.0, np.inf):
                query, at, far = knn.nearest_angles(x, x, *knn.units(x), np.full(len(x), most), k)
                assert np.allclose(far, d[query, at], rtol=0, atol=2e-12) and (far <= most).all()
                got = np.full(d.shape, np.inf)
                got[query, at] = far
                want = np.where(np.isfinite(d) & (d <= most - 1e-11), d, np.inf)
                want, got = np.sort(want, 1)[:, :k], np.sort(got, 1)[:, :k]
                assert np.allclose(got[np.isfinite(want)], want[np.isfinite(want)], rtol=0, atol=2e-12)
    # equal rows are equally far, whatever stands beside them
    query, at, far = knn.nearest_angles(x, x, *knn.units(x), np.full(len(x), np.inf), len(x))
    held = dict(zip(zip(query.tolist(), at.tolist()), far.tolist()))
    assert all(held[q, i] == held[q, 102 + i] for q in range(60) for i in range(30))
