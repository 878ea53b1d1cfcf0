"""Acquisition and the command line, end to end."""

import json

from vellumine import __main__ as cli
from vellumine.plans import acquire
from vellumine.sources import registry as Reg


def test_acquire(spark, tmp_path):
    kind, status = {"name": "Luật"}, {"name": "Còn hiệu lực"}
    items = [
        {"id": "1", "title": "Luật Lao động", "docType": kind, "effStatus": status, "docNum": "1/2020/QH14", "issueDate": "2020-01-02", "documentContent": {"content": "<p>Điều 1. Phạm vi</p><p>1. Một</p>"}, "signerName": "Ông A"},
        {"id": "2", "title": "Luật lao  động", "docType": kind, "effStatus": status, "docNum": "1/2020/QH14"},
        {"id": "3", "title": "Luật lao động mới", "docType": kind, "effStatus": status},
        {"id": "4", "title": "Luật Đất đai", "docType": kind, "effStatus": status},
    ]
    path = str(tmp_path / "api")
    Reg.write_pages(iter([{"items": items, "total": 4}]), spark, path)
    rows = Reg.read_pages(spark, path).selectExpr("inline(items)")
    chosen = acquire.select(rows, "lao động")
    assert sorted(r["document_id"] for r in chosen.collect()) == ["1", "3"]
    docs = acquire.documents(chosen, rows, "2024-01-01T00:00:00Z")
    by = {r["document_id"]: r for r in docs.collect()}
    assert by["1"]["markdown"].endswith("### Điều 1. Phạm vi\n\n#### Khoản 1\nMột") and by["1"]["metadata"]["nguoi_ky"] == "Ông A"
    assert by["3"]["error"] == "no content" and by["3"]["markdown"] is None
    empty = spark.createDataFrame([], Reg.SCHEMA + ", seq bigint")
    reg = {r["document_id"]: r for r in acquire.registered(empty, docs, 1).collect()}
    assert (reg["1"]["crawl_status"], reg["1"]["doc_number"], reg["1"]["issue_date"]) == ("crawled", "1/2020/QH14", "02/01/2020") and reg["3"]["crawl_status"] == "error"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "1-2020-nd-cp-nghi-dinh.md").write_text("Điều 1. Phạm vi\n1. Quy định về lao động.", encoding="utf-8")
    index = str(tmp_path / "index")
    cli.main(["ingest", "--data-dir", str(tmp_path / "md"), "--index-dir", index, "--work-dir", str(tmp_path / "work"), "--chunk-size", "500"])
    cli.main(["answer", "--index-dir", index, "--questions", '["lao động"]', "--rerank-top-k", "2", "--graph-enabled", "no"])
    assert "lao động" in json.loads(capsys.readouterr().out.strip().splitlines()[-1])["answer"]
    cli.main(["evaluate", "--index-dir", index, "--questions", '["lao động"]', "--ground-truths", '["Quy định về lao động"]', "--output", str(tmp_path / "scores"), "--graph-enabled", "no"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["context_recall"] == 1.0


def test_crawl(tmp_path, spark, capsys):
    """Search, details, files and registry; a second crawl updates, and failures keep what was stored."""
    from vellumine.sources import client as W

    down = set()

    def ask(path, query, body):
        if path == W.SEARCH:
            items = [{"id": str(i), "title": f"Luật Lao động {i}", "docType": {"name": "Luật"}, "effStatus": {"name": "Còn hiệu lực"}, "docNum": f"{i}/2020/QH14"} for i in (1, 2)]
            return {"data": {"items": items if body["pageNumber"] == 1 else [], "total": 2}}
        if path == W.CATEGORIES:
            raise OSError("not there")
        i = path.rsplit("/", 1)[1]
        if i in down:
            raise OSError("timed out")
        return {"data": {"id": i, "title": f"Luật Lao động {i}", "docType": {"name": "Luật"}, "effStatus": {"name": "Còn hiệu lực"}, "documentContent": {"content": f"<p>Điều 1. Phạm vi {i}</p><p>1. Một</p>"}}}

    out = str(tmp_path / "out")
    client = W.Client(ask, 0.0, lambda s: None)
    cli.main(["crawl", "--output-dir", out, "--write-json", "--include-content-json"], client)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"documents": 2}
    names = sorted(p.name for p in (tmp_path / "out" / "markdown").glob("*.md"))
    assert names == ["1-2020-qh14-luat-lao-dong-1.md", "2-2020-qh14-luat-lao-dong-2.md"]
    side = json.loads((tmp_path / "out" / "json" / "1-2020-qh14-luat-lao-dong-1.json").read_text(encoding="utf-8"))
    assert side["document_id"] == "1" and side["content_tree"][0]["text"] == "Điều 1. Phạm vi 1"
    down.add("2")
    cli.main(["crawl", "--output-dir", out], client)
    rows = {r["document_id"]: r for r in spark.read.parquet(f"{out}/registry.parquet").collect()}
    assert (rows["1"]["crawl_status"], rows["2"]["crawl_status"], rows["2"]["markdown_path"]) == ("crawled", "error", "markdown/2-2020-qh14-luat-lao-dong-2.md")
    cli.main(["crawl", "--output-dir", str(tmp_path / "none"), "--keyword", "không có"], client)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"documents": 0}


def test_ingest_replaces_documents(spark, tmp_path):
    """A second ingest adds and replaces by document; nothing old of a replaced one is left, and --reset starts anew."""
    md, index = tmp_path / "md", str(tmp_path / "index")
    md.mkdir()
    base = ["ingest", "--data-dir", str(md), "--index-dir", index, "--work-dir", str(tmp_path / "work"), "--audit-output", str(tmp_path / "audit")]
    (md / "a.md").write_text("Điều 1. Một\n1. cũ\n2. cũ hai", encoding="utf-8")
    (md / "b.md").write_text("Điều 1. Hai\n1. giữ", encoding="utf-8")
    cli.main(base)
    said = lambda: sorted(r["content"] for r in spark.read.parquet(f"{index}/chunks").collect())
    assert said() == ["cũ", "cũ hai", "giữ"]
    (md / "b.md").unlink()
    (md / "a.md").write_text("Điều 1. Một\n1. mới", encoding="utf-8")
    cli.main(base)
    assert said() == ["giữ", "mới"] and spark.read.parquet(f"{index}/vectors").count() == 2
    assert {r["text"] for r in spark.read.parquet(f"{index}/nodes").filter("unit_type = 'clause'").collect()} == {"giữ", "mới"}
    cli.main([*base, "--reset"])
    assert said() == ["mới"]
    counts = json.loads(next((tmp_path / "audit").glob("*.json")).read_text())
    assert counts["documents_seen"] == 1 and counts["primary_units"] == 1
