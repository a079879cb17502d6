"""Operators on hand-made rows with results worked out by hand."""

import collections
import datetime
import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import values as V
from siltstone.functions import vectors as X
from siltstone.operators import chunking, clustering, diversity, embedding, evaluation, filters, inspection, retrieval, sync, tabular, web
from siltstone.plans import search
from siltstone.sources import collections as C
from siltstone.sources import delimited as D
from siltstone.sources import extract, transfer
from siltstone.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_missing_fields(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, f int")
    pick = lambda spec: [r[0] for r in rows(df.where(filters.where(spec)), "id")]
    assert pick({"f": 5}) == [1]
    assert pick({"f": {"$ne": 5}}) == [2, 3]
    assert pick({"f": {"$nin": [5]}}) == [2, 3]
    assert pick({"f": {"$gt": 5}}) == [3]
    assert pick({"$or": [{"f": 7}, {"f": {"$lt": 6}}]}) == [1, 3]
    assert pick({}) == [1, 2, 3]


def test_filter_problems_and_round_trip():
    assert filters.Leaf("f", "$gt", "x").problems()
    assert filters.Leaf("f", "$in", [1, "a"]).problems()
    tree = filters.parse({"$and": [{"a": {"$eq": 1}}, {"$or": [{"b": {"$ne": "x"}}, {"c": {"$in": [1, 2]}}]}]})
    assert filters.parse(tree.to_json()).to_json() == tree.to_json()
    assert filters.Group("$and", [filters.Leaf("", "$eq", 1), filters.Leaf("a", "$eq", 1)]).pruned().to_json() == {"a": {"$eq": 1}}
    assert filters.Group().pruned() is None
    with pytest.raises(ValueError):
        filters.parse({"$not": []})
    assert [filters.typed(x) for x in ("5", " 2.5", "true", "x ")] == [5, 2.5, True, "x"]


def test_text_functions(spark):
    assert T.query_terms("a big, BIG dog") == ["big", "BIG", "dog"]
    assert T.case_variants("ab") == ["ab", "Ab", "AB"]
    assert one(spark, T.occurrences(T.folded(F.lit("Élan  élan")), F.lit("elan"))) == 2
    assert one(spark, T.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, F.lit("a рискованный").rlike(T.alternation(["РИСК"])))
    assert not one(spark, F.lit("прориск").rlike(T.alternation(["риск"])))
    assert one(spark, F.lit("ёж").rlike(T.alternation(["еж"])))
    assert one(spark, T.tags(F.lit("Red, blue,red , ,Blue"))) == ["Red", "blue"]
    assert "hunter2" not in one(spark, T.masked(F.lit("password=hunter2 api_key: abc Bearer zzz")))


def test_values(spark):
    kinds = [one(spark, V.inferred_kind(F.lit(x))) for x in ("5", "5d", "-2.5e3", "true", "True", "")]
    assert kinds == ["integer", "string", "number", "boolean", "string", "string"]
    assert [one(spark, V.delimited_kind(F.lit(x))) for x in ("007", "12", "2024-02-30", "2024-02-28", "истина", "")] == ["text", "number", "text", "date", "boolean", "empty"]
    assert [one(spark, V.as_boolean(F.lit(x))) for x in ("да", "NO", "maybe")] == [True, False, None]
    assert one(spark, V.excel_date(F.lit(1.0))) == datetime.datetime(1900, 1, 1)
    assert one(spark, V.excel_date(F.lit(60.0))) is None
    assert one(spark, V.excel_date(F.lit(61.0))) == datetime.datetime(1900, 3, 1)
    assert [V.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [V.column_index(x) for x in ("A", "Z", "AA")] == [0, 25, 26]
    assert V.fnv1a("") == "cbf29ce484222325"
    assert one(spark, V.version_key(F.lit("v1.10.0")) > V.version_key(F.lit("1.9.9")))
    now = datetime.datetime(2024, 1, 3, 10, 30)
    assert V.next_run(now, "hourly", minute=15) == datetime.datetime(2024, 1, 3, 11, 15)
    assert V.next_run(now, "daily", 10, 30) == datetime.datetime(2024, 1, 4, 10, 30)
    assert V.next_run(now, "weekly", 9, 0, 2) == datetime.datetime(2024, 1, 10, 9, 0)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, X.dot(a, b)) == 24
    assert one(spark, X.dot(a, F.array(F.lit(1.0)))) == 0
    assert one(spark, X.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, X.distance(a, b, "l2")) == 2
    assert one(spark, X.distance(a, b, "ip")) == -23
    assert one(spark, X.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, X.similarity(F.lit(1.5))) == 0
    assert one(spark, X.mean(F.array(a, b), 2)) == [3.5, 3.5]


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("abc")], "query_id long, id string, position int")
    b = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate("da")], "query_id long, id string, position int")
    got = [(r["id"], r["score"]) for r in retrieval.fuse([(a, 1), (b, 1)]).orderBy("position").collect()]
    assert [g[0] for g in got] == ["a", "d", "b", "c"]
    assert [g[1] for g in got] == pytest.approx([1 / 61 + 1 / 62, 1 / 61, 1 / 62, 1 / 63])


def test_text_score_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "dog"), (3, "bird")], "id long, document string")
    once = {r["id"]: r["score"] for r in retrieval.text_candidates(docs, "cat dog").collect()}
    twice = {r["id"]: r["score"] for r in retrieval.text_candidates(docs, "cat dog dog").collect()}
    assert twice[2] == pytest.approx(2 * once[2])
    single = {r["id"]: r["score"] for r in retrieval.text_candidates(docs, "dog").collect()}
    assert single[2] == pytest.approx(1 / 3**0.5)


def test_text_score_of_empty_documents(spark):
    docs = spark.createDataFrame([(1, "dog", "bird"), (2, "", "bird"), (3, "", "a dog"), (4, None, "a dog"), (5, "cat dog", "dog")], "id long, document string, heading string")
    for query in ("dog", "cat dog"):
        assert {r["id"] for r in retrieval.text_candidates(docs, query).collect()} == {1, 5}
        assert {r["id"] for r in retrieval.text_candidates(docs, query, 10).collect()} == {1, 5}
        found = {r["id"]: r for r in retrieval.text_candidates(docs, query, headings="heading").collect()}
        assert set(found) == {1, 3, 5} and found[3]["position"] == 1 and found[3]["score"] == float("inf") and found[1]["relevance"] == 0
        assert [r["id"] for r in retrieval.text_candidates(docs, query, 1, headings="heading").collect()] == [3]


def test_stages(spark, rows):
    hits = spark.createDataFrame([(0, 1, 1, "aa  b", "p", 0.3, "none"), (0, 2, 2, "aa b", "p", 0.1, "pinned"), (0, 3, 3, "c", None, 0.5, "stale")], "query_id long, id long, position int, document string, parent_id string, distance double, mark string")
    assert rows(retrieval.collapse_parents(hits), "id", "collapsed", "distance") == [(1, 1, 0.1), (3, 0, 0.5)]
    assert rows(retrieval.collapse_copies(hits), "id") == [(1,), (3,)]
    assert rows(retrieval.apply_marks(hits), "id", "position") == [(1, 2), (2, 1), (3, 3)]
    verdicts = spark.createDataFrame([(0, 3, 0.9)], "query_id long, id long, score double")
    assert rows(retrieval.reorder(hits, verdicts), "id", "position") == [(1, 2), (2, 3), (3, 1)]
    assert [one(spark, retrieval.parsed_score(F.lit(x))) for x in ("Yes.", "нет", "score: 0.7", "hm")] == [1, 0, 0.7, None]
    assert retrieval.fair_shares([10, 100, 100], 100) == [10, 45, 45]
    assert retrieval.pool_size(200, False) == 100 and retrieval.pool_size(2, True) == 20 and retrieval.pool_size(10, True) == 50


def test_context_stops_at_the_first_gap(spark, rows):
    chunks = spark.createDataFrame([(i, "f", i, "t") for i in (1, 2, 3, 5, 6)], "id long, file string, chunk_index long, document string")
    hits = chunks.where("id = 3").withColumn("query_id", F.lit(0))
    assert rows(retrieval.with_neighbours(hits, chunks, 3), "id") == [(1,), (2,)]


def test_diversity():
    rel = np.array([1.0, 0.9, 0.5])
    v = np.array([[1, 0], [1, 0], [0, 1]], float)
    assert diversity.choose(rel, v, 3, 0.5) == [0, 2, 1]
    assert diversity.choose(rel, v, 3, 1.0) == [0, 1, 2]
    assert diversity.choose(np.ones(3), v[:1].repeat(3, 0), 2, 0.7) == [0, 1]


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "v", 1, "a"), ("q", "v", 2, "b"), ("q", "v", 3, "c")], "query_id string, variant string, position int, id string")
    truth = spark.createDataFrame([("q", "b", 1.0), ("q", "z", 0.5)], "query_id string, id string, gain double")
    cells = hits.select("query_id", "variant").distinct()
    got = {(r["metric"], r["k"]): r["value"] for r in evaluation.metrics(evaluation.graded(hits, truth), truth, cells, [1, 3]).collect()}
    assert got["hit_rate", 1] == 0 and got["hit_rate", 3] == 1 and got["recall", 3] == 0.5 and got["mrr", 0] == 0.5
    assert got["ndcg", 3] == pytest.approx((1 / np.log2(3)) / (1 + 0.5 / np.log2(3)))


def test_kmeans_separates(spark):
    rng = np.random.default_rng(1)
    data = [(i, (np.eye(8)[i % 4] + rng.normal(0, 0.05, 8)).tolist()) for i in range(80)]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    centroids = clustering.fit(df, 4, 8)
    groups = {}
    for r in clustering.assign(df, centroids).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert clustering.silhouette(df, clustering.assign(df, centroids)) > 0.7
    assert clustering.default_k(9) == 4 and clustering.default_k(100_000) == 24


def test_chunkers(spark):
    assert chunking.fixed("x" * 10, 20, 5) == ["x" * 10]
    assert chunking.fixed("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.recursive("aaa. bbb. ccc", 10, 0) == ["aaa. bbb.", "ccc"]
    assert chunking.markdown_sections("# A\nx\n```\n# no\n```\n## B\ny\n### C\nz", 2) == ["# A\nx\n```\n# no\n```", "## B\ny\n### C\nz"]
    assert chunking.html_sections("a<section>b<section>c</section></section>d", ("section",)) == ["a", "<section>b<section>c</section></section>", "d"]
    assert chunking.code_sections("import x\n\ndef a():\n  1\n\nclass B:\n  2") == ["import x", "def a():\n  1", "class B:\n  2"]
    assert chunking.sentences("Hi. A! b") == ["Hi.", "A!", "b"]
    two = chunking.hierarchical("one two three four " * 60, chunking.Config(size_tokens=100, child_tokens=20))
    assert {c.level for c in two} == {0, 1} and all(two[c.parent].level == 1 for c in two if c.level == 0)
    clean = chunking.hygiene([chunking.Chunk("a"), chunking.Chunk("---"), chunking.Chunk("b")])
    assert [c.text for c in clean] == ["a\n---", "b"]
    table = chunking.with_table_headers([chunking.Chunk("| a |\n| --- |\n| 1 |"), chunking.Chunk("| 2 |")])
    assert table[1].text == "| a |\n| --- |\n| 2 |"
    assert all(len(t) <= 85 for t in chunking.fit_to_limit(["word " * 100], 100))
    assert chunking.lead_ins("Things to buy:\n- a\n- b") == {1: "Things to buy:", 2: "Things to buy:"}
    assert chunking.locate("aa bb aa", [chunking.Chunk("aa"), chunking.Chunk("aa")]) == [(0, 2), (6, 8)]
    assert chunking.parse_model_chunks('```json\n["a", {"text": "b"}]\n```') == ["a", "b"]
    assert chunking.parse_model_chunks("no") is None
    noted = chunking.model_based("some text here", lambda w: "?", chunking.Config())
    assert noted[0].note
    c = chunking.Config()
    assert chunking.compare_hash(c.params_hash(), c) == "matches" and chunking.compare_hash(None, c) == "migrate" and chunking.compare_hash("v1:x", c) == "differs"
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "text string")
    assert [r["chunk"] for r in chunking.fixed_chunks(df, 4, 1).collect()] == ["abcd", "defg", "ghij", ""]


def test_row_diff_costs_one_vector_for_an_insert(spark, rows):
    schema = "row_number long, row_key string, text_hash string, metadata_hash string"
    old = spark.createDataFrame([(1, None, "a", "m"), (2, None, "b", "m"), (3, None, "b", "m")], schema)
    new = spark.createDataFrame([(1, None, "x", "m"), (2, None, "a", "m"), (3, None, "b", "m"), (4, None, "b", "n")], schema)
    got = dict((r[0], r[2]) for r in rows(sync.row_diff(new, old)))
    assert got == {1: "added", 2: "unchanged", 3: "unchanged", 4: "metadata_only"}


def test_sync_names(spark):
    assert one(spark, sync.collection_name(F.lit("--my docs!/2024"))) == "my-docs-2024"
    assert one(spark, sync.collection_name(F.lit("a"))) == "acol"
    assert sync.schema_coverage(["a", "b", "c"], ["a"], {"b": 1}) == ["c"]


def test_tabular(spark, rows):
    sheets = {
        "plain": [["Name", "Age"], ["Ann", 3], ["Bob", 4]], "spaced": [[], ["Name", None, "Age", ""], ["Ann", None, 3], ["Bob", None, 4]], "report": [["Report", 2024], ["a", "b"]],
        "mixed": [["a", "b"], ["x", 1], [2, "y"]], "text": [["just text"]], "blank": [[None, " "]], "bare": [["a", "b"]], "hidden": [["Name", "Age"], ["Ann", 3]],
        "long": [["a", "b"]] + [["x", 1]] * 20 + [["x", "y"]] * 9, "half": [["a", None, "c"], ["x", "y", "z"]]}
    cells = [("f", name, i + 1, j, type(v).__name__, str(v)) for name, table in sheets.items() for i, row in enumerate(table) for j, v in enumerate(row) if v is not None]
    cells = spark.createDataFrame(cells, "path string, sheet string, row_number long, col int, kind string, value string")
    known = spark.createDataFrame([("f", name, name == "hidden") for name in sheets], "path string, sheet string, hidden boolean")
    got = {r["sheet"]: (r["mode"], r["header"], r["reason"]) for r in tabular.sheet_modes(cells, known).collect()}
    assert got == {
        "plain": ("data_table", 1, "rows of one kind"), "spaced": ("data_table", 2, "rows of one kind"), "report": ("document", None, "no header row"), "mixed": ("document", 1, "mixed columns"),
        "text": ("document", None, "one column"), "blank": ("skip", None, "empty"), "bare": ("document", 1, "no rows"), "hidden": ("skip", None, "hidden"), "long": ("data_table", 1, "rows of one kind"),
        "half": ("document", None, "no header row")}
    assert {r["sheet"] for r in tabular.sheet_modes(cells).collect()} == set(sheets) - {"blank"}
    assert tabular.titles(["A", None, "A"]) == ["A", "B", "A (2)"]
    assert tabular.keys(["Full Name", "full-name", "row_number", "1st"]) == ["full_name", "full_name_2", "col_row_number", "col_1st"]
    assert tabular.suggested_roles(["id", "Title", "price"]) == ({"id": "metadata", "Title": "text", "price": "metadata"}, "id")
    assert tabular.suggested_roles(["Цена", "код товара"]) == ({"Цена": "text", "код товара": "metadata"}, "код товара")
    assert tabular.unknown_placeholders(tabular.Mapping({"a": "Name"}, [], template="{Name} {Nope}")) == ["Nope"]
    cells = spark.createDataFrame([(1, 1, "x"), (2, 3, "y")], "row int, col int, value string")
    merged = spark.createDataFrame([(1, 1, 2, 2)], "r0 int, c0 int, r1 int, c1 int")
    assert rows(tabular.spread_merged(cells, merged)) == [(1, 1, "x"), (1, 2, "x"), (2, 1, "x"), (2, 2, "x"), (2, 3, "y")]


def test_delimited():
    assert D.parse('a,"b ""q""\nc",d\r\n\r\ne,f,g') == [["a", 'b "q"\nc', "d"], ["e", "f", "g"]]
    assert D.sniff("a;b;c\n1;2,5;3\n") == ";"
    assert D.table("a,,c\n1,2") == (["a", "column2", "c"], [["1", "2", ""]])
    assert D.decode("при".encode("windows-1251")) == "при" and D.decode(b"\xef\xbb\xbfx") == "x"
    assert D.container(b"PK\x03\x04..") == "zip" and D.container(b"hello") is None
    assert D.plain_text(b"\0" * 10 + b"x") is None
    names, found = D.json_records('{"items": [{"b": 1, "a": "x"}, {"c": null}]}')
    assert names == ["a", "b", "c"] and found[0] == {"b": "1", "a": "x"}
    assert D.suggested_mapping(["ID", "body", "x"]) == {"ID": "id", "body": "text", "x": "metadata"}


def xlsx():
    out = io.BytesIO()
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>hello</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" s="1"><v>61</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
    return out.getvalue()


def test_xlsx(spark):
    assert D.read_xlsx(xlsx()) == {"S": [(2, {0: "hello", 1: datetime.datetime(1900, 3, 1), 2: True, 3: 2.5}), (3, {0: "hello"})]}
    df = spark.createDataFrame([("a.xlsx", bytearray(xlsx()))], "path string, content binary")
    assert D.sheet_cells(df).count() == 5


def test_ods():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", '<o:d xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:table t:name="S"><t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="float" o:value="3" t:number-columns-repeated="2"/><t:table-cell o:value-type="string"><x:p>hi</x:p></t:table-cell></t:table-row></t:table></o:d>')
    assert D.read_ods(out.getvalue()) == {"S": [(1, {0: 3.0, 1: 3.0, 2: "hi"}), (2, {0: 3.0, 1: 3.0, 2: "hi"})]}


def test_collections(spark, rows, tmp_path):
    cat = C.Catalog(spark, str(tmp_path))
    cat.create("docs", "cosine", {"model": "m"})
    with pytest.raises(ValueError):
        cat.create("docs")
    assert cat.create("docs", get_or_create=True).metadata == {"model": "m"}
    cat.upsert("docs", spark.createDataFrame([(1, "a"), (2, "b")], "id long, document string"))
    cat.upsert("docs", spark.createDataFrame([(2, "B"), (3, "c")], "id long, document string"))
    assert rows(cat.read("docs")) == [(1, "a"), (2, "B"), (3, "c")]
    cat.delete("docs", where=F.col("document") == "a")
    cat.delete("docs", spark.createDataFrame([(3,)], "id long"))
    assert rows(cat.read("docs")) == [(2, "B")]
    with pytest.raises(ValueError):
        cat.delete("docs")
    with pytest.raises(PermissionError):
        C.Catalog(spark, str(tmp_path), read_only=True).drop("docs")
    cat.reset()
    assert cat.names() == []


def test_export_and_import(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", "x", {"k": "1"}, [1.0]), ("b", "y", None, None)], transfer.RECORD.replace(", _broken string", ""))
    made = transfer.export_collection(df, str(tmp_path / "p"), {"metric": "cosine"})
    again = transfer.export_collection(df.repartition(2), str(tmp_path / "q"), {"metric": "cosine"})
    assert made["documents"] == 2 and made["digest"] == again["digest"]
    (tmp_path / "p" / "documents.jsonl" / "part-bad.txt").write_text("{broken\n")
    manifest, records = transfer.read_package(spark, str(tmp_path / "p"))
    plan = transfer.import_plan(records, spark.createDataFrame([("a",)], "id string"), "skip")
    assert sorted(r["action"] for r in plan.collect()) == ["broken", "skip", "write"]
    assert transfer.compatible(manifest, {"metric": "l2"}) and not transfer.compatible(manifest, {"metric": "cosine"})


def test_web(rows, spark):
    page = web.read_page('<html><head><title> T </title></head><body><nav>no</nav><h2>Head</h2><p>a <b>b</b></p><ul><li>x</li></ul><table><tr><th>k</th></tr><tr><td>v|w</td></tr></table><a href="/p#f">l</a></body></html>', "http://e.org/d/")
    assert page["title"] == "T" and "no" not in page["text"] and "| v\\|w |" in page["text"] and page["links"] == ["http://e.org/p"]
    assert page["headings"][0][:2] == (2, "Head")
    rules = web.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: x\nDisallow: /")
    assert web.robots_allows(rules, "/a/b/c") and not web.robots_allows(rules, "/a/c") and not web.robots_allows(rules, "/z.pdf") and web.robots_allows(rules, "/z.pdfx")
    assert not web.robots_allows(web.robots_rules("User-agent: *\nAllow: /\n\nUser-agent: x\nDisallow: /", "X-bot"), "/q")
    assert web.sitemap_urls("<urlset><url><loc> http://a/?x=1&amp;y </loc></url></urlset>") == (["http://a/?x=1&y"], [])
    assert one(spark, web.normalised_url(F.lit("HTTP://Ex.org:80?q#f"))) == "http://ex.org/?q"
    pages = spark.createDataFrame([("http://a/",), ("http://a/1",), ("http://a/2",), ("http://a/3",)], "url string")
    links = spark.createDataFrame([("http://a", "http://a/1"), ("http://a/1", "http://a/2"), ("http://a/2", "http://a/"), ("http://a/1", "http://b/")], "url string, target string")
    assert rows(web.crawl(pages, links, pages.limit(1))) == [("http://a/", 0), ("http://a/1", 1), ("http://a/2", 2)]
    assert web.decoded("при".encode("windows-1251")) == "при"
    assert web.reflowed(["A hyphen-", "ated word", "", "- item"]) == "A hyphenated word\n\n- item"


def test_token_bucket(spark, rows):
    ev = spark.createDataFrame([(1, 7, datetime.datetime(2024, 1, 1)), (2, 7, datetime.datetime(2024, 1, 1)), (3, 8, datetime.datetime(2024, 1, 1))], "event_id long, user_id long, ts timestamp")
    assert rows(E.rate_limited(ev, "user_id", 60, 1)) == [(1, 7, True, None, 0), (2, 7, False, "client", 1), (3, 8, True, None, 0)]


def test_streams(spark, rows, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    E.audit_sink(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    seen = []
    E.watch_folder(spark, str(tmp_path / "in"), ev.schema, lambda df, n: seen.append(df.count()), str(tmp_path / "c2"), once=True).awaitTermination(120)
    assert sum(seen) == 50


def test_sheet_rows_beyond_a_limit_are_counted(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(xlsx()))], "path string, content binary")
    got = [(r["row_number"], r["kind"], r["value"]) for r in D.sheet_cells(files, "xlsx", 1).collect()]
    assert (None, "rows_left", "1") in got and all(n in (2, None) for n, _, _ in got)
    assert {r["row_number"] for r in D.sheet_cells(files).collect()} == {2, 3}


def test_code_blocks_of_one_kind():
    text = "import x\n\ndef f():\n    pass\n\nclass A:\n    def g(self):\n        pass\n"
    assert len(chunking.code_sections(text)) == 3
    assert [s.split("\n")[0] for s in chunking.code_sections(text, "classes")] == ["import x", "class A:"]
    assert [s.split("\n")[0] for s in chunking.code_sections(text, "functions")] == ["import x", "def f():"]


def test_sentences():
    assert chunking.sentences("One. Two!  \n.\nA? b... c") == ["One.", "Two!", ".\nA?", "b.", "..", "c"]


def test_batches_hold_their_limits(spark):
    df = spark.createDataFrame([(i, 60) for i in range(10)] + [(10, 500)], "id long, n long")
    got = collections.defaultdict(list)
    for r in C.batches(df, 3, 128 + 130, F.col("n")).collect():
        got[r["batch"]].append(r["id"])
    assert got == {0: [0, 1], 1: [2, 3], 2: [4, 5], 3: [6, 7], 4: [8, 9], None: [10]}
    few = C.batches(df, 3, 1000, F.col("n")).groupBy("batch").agg(F.count("*").alias("n"), F.sum("n").alias("bytes")).collect()
    assert all(r["n"] <= 3 and r["bytes"] + 128 <= 1000 for r in few)
    row = spark.createDataFrame([("i", 'a"b\\\n', None)], "id string, document string, m string")
    assert row.select(C.record_bytes(F.col("id"), F.col("document"), F.lit(2), {"m": F.col("m")})).first()[0] == 3 + 1 + (5 + 2 + 2 + 5) + 1 + 50 + 4 + (1 + 4 + 4)


def test_search_profile_stages(spark):
    rows = [(i, f"text number {i} {'needle' if i == 3 else ''}", [float(i == k) for k in range(4)], "f", i) for i in range(4)]
    docs = spark.createDataFrame(rows, "id long, document string, embedding array<double>, file string, chunk_index long")
    asked = []

    def embed(texts):
        asked.extend(texts)
        return [[0.0, 1.0, 0.0, 0.0]]

    profile = search.SearchProfile(query_prefix="query: ", context_window=1, rerank_head=4, n_results=4)
    judge = lambda hits: hits.select("query_id", "id", F.col("id").cast("double").alias("score"))
    got = search.hybrid_search(docs, "needle", None, profile, embed=embed, judge=judge).orderBy("position").collect()
    assert asked == ["query: needle"] and [r["id"] for r in got] == [3, 2, 1, 0]
    assert "rerank" in profile.stages() and "context" in profile.stages()
    first = docs.where("id = 1").select("id", "embedding")
    alone = search.hybrid_search(docs, "x", first, search.SearchProfile(context_window=1, n_results=1, use_text=False)).select("id", "context").first()
    assert alone["id"] == 1 and [(c["offset"], c["id"]) for c in alone["context"]] == [(-1, 0), (1, 2)]


def test_stages_that_changed_nothing(spark):
    one = lambda *rows: retrieval.changed_nothing(spark.createDataFrame(list(rows), "stage string, ran boolean, rows_in long, rows_out long")).first()[0]
    assert one(("collapse", True, 9, 9), ("diversity", False, 9, 9)) and not one(("collapse", True, 9, 8)) and not one(("rerank", True, 9, 9))


def test_path_repair(spark):
    import unicodedata

    decomposed = unicodedata.normalize("NFD", "Отчёт й.pdf")
    good = hashlib.sha256("a.txt".encode()).hexdigest()[:16]
    df = spark.createDataFrame([(1, decomposed, None), (2, "a.txt", good), (3, "a.txt", "other"), (4, None, None)], "id long, source_file string, file_id string")
    got = {r["id"]: (r["source_file"], r["file_id"]) for r in C.path_repairs(df).collect()}
    composed = unicodedata.normalize("NFC", decomposed)
    assert got == {1: (composed, hashlib.sha256(composed.encode()).hexdigest()[:16]), 3: ("a.txt", good)}


def test_evaluation_report(spark):
    df = spark.createDataFrame([("a|b", "hit_rate", 1, 0.5), ("c", "hit_rate", 1, 0.25), ("a|b", "mrr", 0, 0.1), ("c", "mrr", 0, 0.2)], "variant string, metric string, k int, value double")
    text, data = evaluation.report(df, "Run")
    assert "| metric | a\\|b | c |" in text and "| hit_rate@1 | **0.500** | 0.250 |" in text and "| mrr | 0.100 | **0.200** |" in text
    assert data["metrics"][0] == {"metric": "hit_rate", "k": 1, "values": {"a|b": 0.5, "c": 0.25}}


def test_sheet_manifest_after_a_plan(spark, rows):
    cols = "identity string, document_id string, row_number int, text_hash string, metadata_hash string"
    old = spark.createDataFrame([("a", "d1", 1, "t", "m"), ("b", "d2", 2, "t", "m"), ("c", "d3", 3, "t", "m")], cols)
    plan = spark.createDataFrame([("a", "d1", 1, "t2", "m", "re_embedded"), ("b", "d2", 2, "t", "m", "disappeared"), ("d", "d4", 4, "t", "m", "added")], cols + ", status string")
    got = rows(tabular.manifest_after(old, plan, spark.createDataFrame([("c",)], "identity string")), "identity", "text_hash")
    assert got == [("a", "t2"), ("b", "t"), ("d", "t")]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_extractors(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    word = zipped({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert extract.docx(word) == "## Head\n\none \ttwo\n\n| a | b |\n| --- | --- |"
    t = 'xmlns:office="o" xmlns:text="t"'
    assert extract.odt(zipped({"content.xml": f'<office:d {t}><text:h text:outline-level="2">Head</text:h><text:p>some  <text:span>text</text:span></text:p></office:d>'})) == "## Head\n\nsome text"
    book = zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>', "o/b.opf": '<package><manifest><item id="x" href="c%202.html"/><item id="y" href="c1.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>', "o/c1.html": "<p>first</p>", "o/c 2.html": "<p>second</p>"})
    assert extract.epub(book) == "first\n\nsecond"
    show = zipped({f"ppt/slides/slide{n}.xml": f"<s><p><t>slide</t><t> {n}</t></p></s>" for n in (10, 2)} | {"ppt/slides/slide3.xml": "<s/>"})
    assert extract.slides(show) == ["slide 2", "", "slide 10"]
    files = spark.createDataFrame([("a.docx", bytearray(word)), ("b.docx", bytearray(b"broken")), ("c.txt", bytearray(b" \n")), ("d.pdf", bytearray(b"x")), ("e.xlsx", bytearray(xlsx()))], "path string, content binary")
    got = {r["path"]: (r["extractor"], r["problem"] and r["problem"].split(":")[0]) for r in extract.extracted(files).collect()}
    assert got == {"a.docx": ("docx", None), "b.docx": ("docx", "BadZipFile"), "c.txt": ("plain", "no text"), "d.pdf": (None, "no extractor"), "e.xlsx": ("xlsx", None)}
    chunks = extract.slide_chunks(spark.createDataFrame([("s.pptx", bytearray(show))], "path string, content binary")).collect()
    assert [(r["slide"], r["document"]) for r in chunks] == [(1, "slide 2"), (3, "slide 10")]
    scanned = [("picture", ("pdf",), lambda data: (_ for _ in ()).throw(extract.NoText())), ("reader", ("pdf",), lambda data: "read")]
    assert extract.extract("d.pdf", b"x", scanned) == ("reader", "read", None)


def test_reembedding_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(40, None)], "id long, document string")
    embed = chunking.hashing_embedder(8)
    out = embedding.reembed(rows, str(tmp_path / "v"), embed, 4)
    assert out.count() == 41 and out.where("embedding is null").count() == 1
    import shutil

    shutil.rmtree(tmp_path / "v" / "part=2")
    before = {k: (tmp_path / "v" / f"part={k}" / "_SUCCESS").stat().st_mtime_ns for k in (0, 1, 3)}
    again = embedding.reembed(rows, str(tmp_path / "v"), embed, 4)
    assert {r["id"]: r["embedding"] for r in again.collect()}.keys() == set(range(41))
    assert before == {k: (tmp_path / "v" / f"part={k}" / "_SUCCESS").stat().st_mtime_ns for k in (0, 1, 3)}
    with pytest.raises(ValueError, match="41 of 39"):
        embedding.reembed(rows.where("id < 39"), str(tmp_path / "v"), embed, 4)


def test_input_limit_and_context(spark):
    seen = lambda texts: [[float(len(t[:37])), 1.0] for t in texts]
    assert abs(embedding.input_limit(seen, "x" * 200, 0.9999999999) - 37) <= 1
    df = spark.createDataFrame([("whole", "good"), ("whole", "bad"), ("whole", None)], "whole string, document string")

    def complete(whole, text):
        if text == "bad":
            raise OSError
        return f"of  {whole}"

    assert [r["document"] for r in embedding.with_context(df, complete).collect()] == ["of whole\n\ngood", "bad", None]


def test_chunkers_by_hand():
    assert chunking.fixed("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.recursive("one two three. four five six. seven", 15, 0) == ["one two three.", "four five six.", "seven"]
    small = chunking.Config(size_tokens=10, chars_per_token=4, child_tokens=8, overlap_percent=0)
    got = chunking.hierarchical("alpha beta gamma delta. " * 3, small)
    parents = [c for c in got if c.level == 1]
    assert all(len(c.text) <= 40 for c in parents) and all(c.parent is not None and got[c.parent].text.find(c.text) >= 0 for c in got if c.level == 0)
    outline = chunking.outline_sections("intro A one B two", [(1, "A", 6), (1, "B", 12), (3, "deep", 14)], 2)
    assert outline == [("", "intro "), ("A", "A one "), ("B", "B two")]
    dense, plain = "1,2;3.4:5/6\n7-8=9", "Words that make up plain prose and go on for quite a while in one line of it."
    assert chunking.density(dense) > chunking.density(plain)
    blocks = "\n\n".join([plain] * 4)
    merged = chunking.adaptive(blocks, chunking.Config(size_tokens=50, chars_per_token=4, minimum_tokens=8))
    assert "\n\n".join(merged) == blocks and len(merged) in (2, 3)


def test_semantic_chunks_turn_where_the_meaning_does():
    text = "Cats purr. Cats sleep. Cats eat. Stars shine. Stars burn. Stars fade."
    embed = lambda parts: [[1.0, 0.0] if "Cats" in p else [0.0, 1.0] for p in parts]
    assert chunking.semantic(text, embed, 5, 200, 0.9, 0) == ["Cats purr. Cats sleep. Cats eat.", "Stars shine. Stars burn. Stars fade."]


def test_duplicate_groups_name_all_their_members(spark, rows):
    df = spark.createDataFrame([(i, " same " if i % 2 else "same", "f") for i in (5, 3, 9, 1)] + [(2, "other", "f"), (4, "", "f"), (6, " ", "f"), (7, None, "f")], "id long, document string, source string")
    assert rows(inspection.duplicates(df, files="source"), "n", "ids", "files") == [(4, [1, 3, 5, 9], ["f"])]
    assert rows(inspection.duplicate_members(df), "id", "n") == [(1, 4), (3, 4), (5, 4), (9, 4)]


def test_chunks_are_handed_on_in_lots(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunking, "LOT_CHARACTERS", 500, raising=False)
    texts = ["", "one two three. " * 40, None, "four five six. " * 60, "seven"]
    given = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    config = chunking.Config("hierarchical", 40)
    lots = list(chunking._lots([given], config, None))
    assert len(lots) > 5 and all(b.num_rows == 1 or sum(map(len, b.column(2).to_pylist())) <= 500 for b in lots)
    got = [tuple(r.values()) for b in lots for r in b.to_pylist()]
    assert got == [(i, n, c.text, c.level, c.parent, c.note) for i, t in enumerate(texts) for n, c in enumerate(chunking.produce(t or "", config))]


def test_a_word_is_hashed_once_whatever_its_occurrences(monkeypatch):
    hashed, blake = [], hashlib.blake2b
    monkeypatch.setattr(chunking.hashlib, "blake2b", lambda data, **k: hashed.append(data) or blake(data, **k))
    texts = ["Zwölf zwölf elf. " * 50, "elf", "", "..."]
    got = chunking.hashing_embedder(8)(texts)
    assert sorted(hashed) == sorted([b"elf", "zwölf".encode()])
    want = np.zeros((4, 8))
    for i, words in enumerate([["zwölf", "zwölf", "elf"] * 50, ["elf"], [], []]):
        for w in words:
            h = int.from_bytes(blake(w.encode(), digest_size=8).digest(), "big")
            want[i, h % 8] += 1.0 if h >> 63 else -1.0
    assert np.array_equal(np.array(got), want)
    assert chunking.hashing_embedder(8)([]) == []


def test_sheet_sync_sends_no_side_through_the_driver(spark):
    rows = spark.createDataFrame([(i, f"n{i}", "b") for i in range(6)], "row_number long, name string, brand string")
    m = tabular.Mapping({"name": "Name", "brand": "Brand"}, ["name"], {"brand": "brand"}, "row_number")
    m.titles["row_number"] = "Number"
    manifest = tabular.row_documents(rows.where("row_number > 1"), m, "s", "t").select("id", "row_number", "row_key", "text_hash", "metadata_hash")
    found = tabular.sheet_sync(rows.where("row_number < 5"), m, manifest, "s", "t")
    for k in ("plan", "manifest", "disappeared"):
        assert "BroadcastHashJoin" not in found[k]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["row_number"], r["status"]) for r in found["plan"].where("row_number < 2").collect()) == [(0, "added"), (1, "added")]
    assert found["manifest"].count() == 6 and found["disappeared"].count() == 1


def test_rounds_of_a_fit_do_not_read_the_table_again(spark):
    rng = np.random.default_rng(5)
    source = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id long, embedding array<double>")

    def reads(rounds):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        clustering.fit(source.mapInArrow(counted, source.schema), 4, 4, rounds=rounds)
        return seen.value

    assert reads(2) == reads(4)


def test_search_numbers_places_without_texts(spark):
    from siltstone.plans import search

    docs = spark.createDataFrame([(i, f"alpha beta {i}", "en") for i in range(6)] + [(9, "alpha alpha", "en")], "id long, document string, lang string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, embedding array<double>")
    places = docs.selectExpr("id", "concat('p', id div 2) AS parent_id")
    query = vectors.where("id = 0")
    profile = search.SearchProfile(collapse_parents=True, diversity=0.5)
    joined = docs.join(vectors, "id").join(places, "id")
    want = search.hybrid_search(joined, "alpha", query, profile).select("id", "position", "parent_id").collect()
    got = search.hybrid_search(docs, "alpha", query, profile, vectors=vectors, places=places, with_vector=True).select("id", "position", "parent_id").collect()
    assert sorted(got) == sorted(want) and len(got) == 3  # nothing without a vector
