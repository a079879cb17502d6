"""Imports that are broken off and taken up again."""

import pytest
from pyspark.sql import functions as F

from siltstone.sources import collections as C
from siltstone.sources import transfer

SCHEMA = "id string, document string, metadata map<string,string>, embedding array<double>"


@pytest.fixture
def package(spark, tmp_path):
    rows = [(f"d{i}", f"text {i}", {"n": str(i)}, [1.0 * i, 1.0] if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6, "id")
    transfer.export_collection(df, str(tmp_path / "package"), {"metric": "cosine"})
    return str(tmp_path / "package")


def catalog_of(spark, tmp_path, held=()):
    catalog = C.Catalog(spark, str(tmp_path / "root"))
    catalog.create("c")
    catalog.upsert("c", spark.createDataFrame([(i, "old", None, [0.0, 1.0]) for i in held] or [], SCHEMA))
    return catalog


def model_of(tmp_path):
    """A model that notes its calls in a file, as it runs in other processes, and fails for some texts while the other file exists."""
    log, bad = str(tmp_path / "calls"), str(tmp_path / "bad")

    def model(texts):
        import os

        if os.path.exists(bad) and any(int(t.split()[1]) > 40 for t in texts):
            raise RuntimeError("the model is gone")
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 2.0] for t in texts]

    return model


@pytest.mark.parametrize("policy", ["skip", "overwrite"])
def test_an_import_goes_on_where_it_stopped(spark, tmp_path, package, policy):
    catalog, model = catalog_of(spark, tmp_path, ["d1", "d2", "x"]), model_of(tmp_path)
    (tmp_path / "bad").touch()
    with pytest.raises(Exception, match="the model is gone"):
        transfer.import_package(catalog, "c", package, policy, model, files_a_batch=1)
    assert catalog.read("c").count() == 3
    (tmp_path / "bad").unlink()
    counts = transfer.import_package(catalog, "c", package, policy, model, files_a_batch=1)
    assert counts == {"written": 58, "overwritten": 2 * (policy == "overwrite"), "skipped": 2 * (policy == "skip"), "broken": 0}
    got = {r["id"]: r for r in catalog.read("c").collect()}
    assert len(got) == catalog.read("c").count() == 61
    assert got["d1"]["document"] == ("old" if policy == "skip" else "text 1") and got["d6"]["embedding"] == [6.0, 2.0] and got["d7"]["embedding"] == [7.0, 1.0]
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    assert set(calls) == {f"text {i}" for i in range(0, 60, 3)}
    finished_before = len(calls)
    assert transfer.import_package(catalog, "c", package, policy, model) == counts
    assert len((tmp_path / "calls").read_text().split("\n")[:-1]) == finished_before


def test_an_import_broken_off_while_the_collection_changes(spark, tmp_path, package, monkeypatch):
    catalog = catalog_of(spark, tmp_path)
    own = catalog.upsert

    def failing(name, rows):
        own(name, rows)
        raise OSError("gone after the switch")

    monkeypatch.setattr(catalog, "upsert", failing)
    with pytest.raises(OSError):
        transfer.import_package(catalog, "c", package)
    monkeypatch.setattr(catalog, "upsert", own)
    assert transfer.import_package(catalog, "c", package) == {"written": 60, "overwritten": 0, "skipped": 0, "broken": 0}
    assert catalog.read("c").count() == 60 and catalog.read("c").select("id").distinct().count() == 60


def test_packages_that_are_refused(spark, tmp_path, package):
    catalog = catalog_of(spark, tmp_path, ["d5"])
    with pytest.raises(ValueError, match="holds records"):
        transfer.import_package(catalog, "c", package, "stop")
    with open(f"{package}/documents.jsonl/part-extra.txt", "w") as f:
        f.write('{"id": "z"}\nno record\n')
    with pytest.raises(ValueError, match="62 lines"):
        transfer.import_package(catalog, "c", package)


def test_broken_lines_are_counted(spark, tmp_path):
    path = str(tmp_path / "p")
    lines = spark.createDataFrame([('{"id":"a","document":"x"}',), ("no record",), ('{"document":"without id"}',)], "value string")
    lines.write.text(f"{path}/documents.jsonl")
    n, size, digest = transfer.digest_of(lines)
    spark.createDataFrame([(f'{{"documents": {n}, "bytes": {size}, "digest": "{digest}"}}',)], "value string").coalesce(1).write.text(f"{path}/manifest.json")
    catalog = catalog_of(spark, tmp_path)
    assert transfer.import_package(catalog, "c", path) == {"written": 1, "overwritten": 0, "skipped": 0, "broken": 2}
    assert [r["id"] for r in catalog.read("c").where(F.col("id") == "a").collect()] == ["a"]
