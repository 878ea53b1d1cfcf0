"""Metadata, sidecars, sinks and models' prompts: the pieces around the operators."""

import json

import numpy as np
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators import chunking as C
from vellumine.operators import evaluation as E
from vellumine.operators import facts as K
from vellumine.operators import graph as G
from vellumine.operators import retrieval as R
from vellumine.sources import client as W
from vellumine.sources import files
from vellumine.sources import html as H
from vellumine.sources import registry as Reg


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_metadata_and_titles_from_text(spark):
    said = "Nghị định số 145/2020/NĐ-CP, Ban hành: 14/12/2020 Ngày hiệu lực 1/2/2021 Ngày hết hiệu lực: 3/4/2025"
    got = value(spark, X.metadata_from_text(F.lit(said)))
    assert got.asDict() == {"ngay_ban_hanh": "14/12/2020", "ngay_hieu_luc": "1/2/2021", "ngay_het_hieu_luc": "3/4/2025", "so_ky_hieu": "145/2020/NĐ-CP"}
    assert set(value(spark, X.metadata_from_text(F.lit(None).cast("string"))).asDict().values()) == {""}
    assert value(spark, X.infer_title(F.lit("xem Nghị định về  lao động Trạng thái: Còn hiệu lực"))) == "Nghị định về lao động" and value(spark, X.infer_title(F.lit("gì đó"))) == ""


def test_categories(spark):
    found = spark.createDataFrame([("Luật", "9"), ("Luật", "7"), ("Khác", "1")], "name string, id string")
    assert {r["name"]: r["id"] for r in Reg.category_ids(found, W.TYPE_IDS).collect()} == W.TYPE_IDS | {"Luật": "9"}
    ask = lambda path, query, body: {"data": {"items": [{"name": " Luật ", "id": "own"}]}} if query["groupCode"] == W.TYPE_GROUP else {}[0]
    assert W.Client(ask).ids(W.TYPE_GROUP, ("Luật", "Thông tư"), W.TYPE_IDS) == ["own"]

    def fails(path, query, body):
        raise OSError("no network")

    assert W.Client(fails).ids(W.STATUS_GROUP, ("Còn hiệu lực",), W.STATUS_IDS) == [W.STATUS_IDS["Còn hiệu lực"]]


def test_search_requests():
    seen, slept = [], []

    def ask(path, query, body):
        seen.append((path, query, body))
        return {"items": [{"id": str(k)} for k in range(100)], "total": 250} if path == W.SEARCH else {}

    c = W.Client(ask, 0.25, slept.append)
    assert sum(len(p["items"]) for p in Reg.api_pages(c.pages("lao động"), W.PAGE_SIZE)) == 300 and slept == [0.25, 0.25]
    body = seen[2][2]
    assert (body["documentName"], body["pageNumber"], body["docType"], "keywordQuickSearch" in body) == ("lao động", 1, list(W.TYPE_IDS.values()), False)
    next(Reg.api_pages(c.pages("x", "all"), W.PAGE_SIZE))
    assert seen[-1][2]["keywordQuickSearch"] == "x" and "documentName" not in seen[-1][2]


def test_equal_results_are_settled_by_order(spark):
    kind = {"name": "Luật"}
    rows = [{"id": "1", "title": f"Luật {x}", "docType": kind, "docNum": x} for x in "cab"]
    for some in (rows, rows[::-1]):
        items = spark.read.schema(Reg.ITEM).json(spark.sparkContext.parallelize([json.dumps(r) for r in some], 3))
        assert [(r["title"], r["metadata"]) for r in Reg.search_results(items).collect()] == [("Luật a", {"so_ky_hieu": "a"})]
    once = Reg.dedupe_results(spark.createDataFrame([("2", "Luật A", {"so_ky_hieu": "1"}, "u2"), ("1", "luật  a", {"so_ky_hieu": "1"}, "u1"), ("3", "B", {}, "u3")], "document_id string, title string, metadata map<string,string>, source_url string"))
    assert sorted(r["document_id"] for r in once.collect()) == ["1", "3"]
    page = "<div><h3>{}</h3><a href='/van-ban/a--5'>x</a> Trạng thái: Còn hiệu lực</div>"
    for order in (("Luật B", "Luật A"), ("Luật A", "Luật B")):
        got = H.search_results(spark.createDataFrame([(page.format(t),) for t in order], "html string"), base="https://h").collect()
        assert [r["title"] for r in got] == ["Luật A"]


def test_clean_metadata_and_order(spark):
    rows = spark.createDataFrame([("1", None, ["x"], {"k": "v"}, 3, "")], "a string, b string, c array<string>, d map<string,string>, e int, f string")
    assert rows.select(Reg.clean_metadata(rows, *rows.columns).alias("m")).first()["m"] == {"a": "1", "c": '["x"]', "d": '{"k":"v"}', "e": "3"}
    reg = spark.createDataFrame([("b", "02/01/2020"), ("a", "01/02/2019"), ("c", "none"), ("d", "02/01/2020")], "document_id string, issue_date string")
    assert [r["document_id"] for r in Reg.in_order(reg).collect()] == ["c", "a", "b", "d"]
    assert value(spark, X.day(F.lit("31/02/2020"))) is None
    hashed = Reg.hashed(spark.createDataFrame([("é",), (None,)], "markdown string")).collect()
    assert [r["content_bytes"] for r in hashed] == [2, 0]


def test_sidecars(spark, tmp_path):
    docs = C.parsed(spark.createDataFrame([("d1", "Điều 1. A\n1. b", "1/2020/X", "Luật một"), ("d2", "", "", "")], "document_id string, content string, doc_number string, title string"))
    tree = json.dumps({"document_id": "d1", "content_tree": [{"text": "Căn cứ Luật số 2/2019/QH14"}, {"text": "Theo pháp luật chung"}, {"items": []}]}, ensure_ascii=False)
    (tmp_path / "d1.json").write_text(tree, encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    side = files.sidecar_folder(spark, str(tmp_path))
    assert [r["document_id"] for r in side.collect()] == ["d1"]
    rels = K.sidecar_relations(docs.join(side, "document_id"), "sidecar")
    assert [(r["relation_type"], r["target_document_number"]) for r in rels.collect()] == [("BASED_ON", "2/2019/QH14")]
    assert [r["target_document_number"] for r in K.relations(docs, sidecars=rels).collect()] == ["2/2019/QH14"] and K.relations(docs).count() == 0
    assert value(spark, K.sidecar_text(F.lit("nothing"))) == ""
    row = docs.select("*", F.lit("json/x").alias("json_path"), F.lit(3).alias("content_bytes"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), F.lit("<p>").alias("content_html"), F.lit("t").alias("content_text"), F.array().alias("content_tree"))
    plain, full = (json.loads(row.select(Reg.sidecar(x).alias("j")).first()["j"]) for x in (False, True))
    assert plain["metadata"] == {"a": "b"} and "content_html" not in plain and full["content_html"] == "<p>" and full["file_path"] == full["markdown_path"]


def test_model_inputs(spark):
    docs = C.parsed(spark.createDataFrame([("d1", "Điều 1. A\n1. " + "x" * 3000 + "\n2. b", "1/2020/X", "Luật một", "https://vbpl.vn/1")], "document_id string, content string, doc_number string, title string, source_url string"))
    units = json.loads(docs.select(K.units_json(limit=1).alias("u")).first()["u"])
    assert len(units) == 1 and len(units[0]["text"]) == 1000 and units[0]["source_clause_id"] == "d1:a1:c1"
    for url, path, public in (("https://VBPL.vn/x", "", True), ("", "a\\vbpl\\b.md", True), ("https://x", "own/b.md", False), (None, None, False)):
        assert value(spark, K.is_public(F.lit(url).cast("string"), F.lit(path).cast("string"))) is public
    asked = docs.withColumn("should_call", F.lit(True))
    got = K.model_payloads(asked, K.prompted(lambda p: F.to_json(F.struct(F.array(F.struct(F.lit("r").alias("raw_text"), F.substring(p, 1, 7).alias("evidence_text"), F.lit(0.8).alias("confidence"))).alias("references")))))
    assert got.first()["payload"]["references"][0]["evidence_text"] == "Extract"
    said = docs.select(K.prompt(F.col("title"), F.lit("body"), F.lit("[]")).alias("p")).first()["p"]
    assert "Title:\nLuật một" in said and said.endswith("Source text:\nbody") and "REFERS_TO" not in said
    assert json.loads(K.EXAMPLE)["references"][0]["ref_type"] == "clause"
    for raw in ('Here: {"references": [{"raw_text": "a", "evidence_text": "b", "confidence": 0.9,},]} bye', '```json\n{"references": [{"raw_text": "a", "evidence_text": "b", "confidence": 0.9}]}\n```'):
        assert value(spark, K.parse_payload(F.lit(raw)))["references"][0]["raw_text"] == "a"


def test_embedding_and_judges(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,), ("b a a",)], "t string").select(R.hashed_embedding("t", 16).alias("e")).collect()
    assert rows[0]["e"] == rows[3]["e"] and abs(np.linalg.norm(rows[0]["e"]) - 1) < 1e-6 and rows[1]["e"] == rows[2]["e"] == [0.0] * 16
    data = spark.createDataFrame([(1, "q a", "a b", ["a b c"], "a b"), (2, "z", "", [], "x")], "query_id int, question string, answer string, contexts array<string>, ground_truth string")
    got = E.judged(data, {"always": lambda *c: F.lit(0.5)}).collect()
    assert [r["always"] for r in got] == [0.5, 0.5]


def test_folders_of_other_files(spark, tmp_path):
    for name, data in (("a.md", "é".encode()), ("b.TXT", b"t"), ("c.pdf", b"%PDF"), ("d.bin", b"\x00")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in files.binary_folder(spark, str(tmp_path), lambda b: F.concat(F.lit("pdf of "), F.length(b))).collect()}
    assert got == {"a.md": "é", "b.TXT": "t", "c.pdf": "pdf of 4", "d.bin": ""}
    pages = spark.createDataFrame([("x/scan.pdf", 2, b"bb"), ("x/scan.pdf", 1, b"a")], "path string, page int, image binary")
    assert files.scanned_pages(pages, lambda i: F.decode(i, "UTF-8")).first()["content"] == "# Tai lieu Scan: scan.pdf\n\n## Trang 1\na\n\n## Trang 2\nbb"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Luật A", "# a", ""), ("2", "Luật  A", "# b", ""), ("3", "Luật B", "é", "1/2020/X"), ("4", "Luật C", None, "")], "document_id string, title string, markdown string, doc_number string")
    assert files.write_markdown(rows, str(tmp_path / "md")) == 3
    assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "md").glob("*.md")} == {"luat-a--1.md": "# a", "luat-a--2.md": "# b", "1-2020-x-luat-b.md": "é"}
    files.write_audit(spark.createDataFrame([(1, {"A": 2})], "documents_seen int, relations_by_type map<string,int>"), str(tmp_path / "audit"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "audit").glob("*.json")] == [{"documents_seen": 1, "relations_by_type": {"A": 2}}]
    old = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "document_id string, t string")
    new = spark.createDataFrame([("1", "n"), ("3", "m")], "document_id string, t string")
    assert sorted(tuple(r) for r in files.replace_documents(old, new).collect()) == [("1", "n"), ("2", "c"), ("3", "m")]


def test_equal_units_are_settled_by_order(spark):
    docs = [("d", "Điều 1. A\n1. x", "1/2020/X", "b"), ("d", "Điều 1. A\n1. x", "1/2020/X", "a")]
    for some in (docs, docs[::-1]):
        parsed = C.parsed(spark.createDataFrame(some, "document_id string, content string, doc_number string, title string"))
        links = G.edges(K.references(parsed), K.amendments(parsed), K.relations(parsed), parsed)
        assert {r["unit_id"]: r["document_title"] for r in G.nodes(parsed, links).collect()} == {"d": "a", "d:a1": "a", "d:a1:c1": "a"}
