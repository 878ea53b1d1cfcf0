"""The citation grammar and the chunkers on hand-written cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.operators import chunking as C
from vellumine.operators import grammar as G
from vellumine.plans import settings as S

OWN = "9/2021/TT"


def one(text, hint="", largest=10, article="7"):
    return [(r["scope"], r["confidence"], r["target_document_number"], r["target_article_no"], r["target_clause_no"], r["target_point"]) for r in G.references(text, OWN, article, hint, largest)]


def test_resolution_ladder():
    assert one("Điều 5 Nghị định số 1/2020/NĐ-CP") == [("external_document", 0.92, "1/2020/NĐ-CP", "5", "", "")]
    assert one("vào Điều 5", hint="2/2020/NĐ-CP") == [("external_document", 0.88, "2/2020/NĐ-CP", "5", "", "")]
    assert one("Điều 3 của Nghị định này") == [("same_document", 0.9, OWN, "3", "", "")]
    assert one("theo Điều 99") == [("ambiguous_external", 0.45, "", "99", "", "")]
    assert one("theo điểm a khoản 2 Điều 3") == [("same_document", 0.8, OWN, "3", "2", "a")]
    assert one("khoản 2 Điều này") == [("same_document", 0.95, OWN, "7", "2", "")]


def test_named_laws_and_amended_lines():
    refs = G.references("Theo Luật Đất đai năm 2013, và Luật số 3/2019/QH14.\nSửa đổi khoản 1 Điều 2", OWN, "1", "", 9)
    assert [(r["raw_text"], r["ref_type"]) for r in refs] == [("Luật Đất đai", "external_document")]


def test_amendments():
    a = G.amendments("Bổ sung khoản 3 vào Điều 8\n“3. mới”\nBãi bỏ điểm a khoản 2 Điều 4", OWN, "", "Luật sửa đổi Luật số 5/2015/QH13")
    assert [(x["operation_text"], x["target_article_no"], x["target_clause_no"], x["target_point"], x["target_document_number"]) for x in a] == [
        ("bổ sung", "8", "3", "", "5/2015/QH13"), ("bãi bỏ", "4", "2", "a", "5/2015/QH13"),
    ]


def test_relations():
    lines = ["Căn cứ Luật số 1/2019/QH14", "Sửa đổi và hướng dẫn Luật số 2/2019/QH14", "Không có gì cả ở đây"]
    assert [(r["hint"], r["target_document_number"]) for r in G.relations(lines, OWN)] == [("based_on", "1/2019/QH14"), ("amendment", "2/2019/QH14"), ("guide", "2/2019/QH14")]
    assert G.relations([f"Căn cứ Thông tư {OWN}"], OWN) == []


def test_anchors():
    key = lambda q: [(a["doc_number"], a["article_no"], a["clause_no"]) for a in G.anchors(q)]
    assert key("khoản 2 Điều 5 Nghị định 145/2020/NĐ-CP") == [("145/2020/NĐ-CP", "5", "2")]
    assert key("Nghị định 145/2020/NĐ-CP tại khoản 1 Điều 6A") == [("145/2020/NĐ-CP", "6a", "1")]
    assert key("Nghị định 145/2020/NĐ-CP. Điều 5") == [("145/2020/NĐ-CP", "", "")]
    assert key("") == [] and key(None) == []


def test_citations():
    assert G.citations("Khoản 1 Điều 2, điều 2 và Nghị định số 1/2020/NĐ-CP; khoản 1  Điều 2") == ["Khoản 1 Điều 2", "điều 2", "Nghị định số 1/2020/NĐ-CP"]


MD = "mở đầu\nChương I\nQUY ĐỊNH CHUNG\n**Điều 1. Phạm vi**\nlời dẫn\n1. Khoản một\n“Điều 9. trích\n2. trong trích”\n2. Khoản hai\nKhoản 2\nlặp lại\nĐiều 2. Sửa đổi Luật số 7/2018/QH14\nĐiều 3. Trống\n"


def test_structure():
    text = C.normalize(MD)
    assert "# Chương I - QUY ĐỊNH CHUNG\n### Điều 1. Phạm vi\nlời dẫn\n#### Khoản 1\nKhoản một\n“Điều 9. trích\n2. trong trích”\n#### Khoản 2\nKhoản hai" in text
    s = C.structure(text, "d", "1/2020/X", "t", "p")
    assert [a["article_no"] for a in s["articles"]] == ["1", "2", "3"]
    assert [(c["id"], c["unit_type"], c["quote_state"]) for c in s["clauses"]] == [
        ("d:a1:c0", "article_intro", "outside_quote"), ("d:a1:c1", "clause", "inside_quote"), ("d:a1:c2", "clause", "outside_quote"), ("d:a1:c2:o2", "clause", "outside_quote"),
        ("d:a2:c0", "article_intro", "outside_quote"),
    ]
    assert s["clauses"][-1]["target_document_number_hint"] == "7/2018/QH14"
    rows = text.splitlines()
    for c in s["clauses"][1:4]:
        assert rows[c["source_start_line"] - 1].startswith("#### Khoản") and c["text"].splitlines()[-1] == rows[c["source_end_line"] - 1]


def test_texts_without_headings():
    s = C.structure("Lời đầu\nI. Phần một\nnội dung\n1) Mục\n\na) ý", "d", "", "Tên", "")
    assert [(c["id"], c["clause_no"], c["confidence"]) for c in s["clauses"]] == [("d:alegacy-1:c1", "1", 0.7), ("d:alegacy-1:cI:o2", "I", 0.7), ("d:alegacy-1:c1:o3", "1", 0.7), ("d:alegacy-1:ca:o4", "a", 0.7)]
    assert s["articles"][0]["title"] == "Tên"
    assert C.structure("", "d", "", "", "") == {"articles": [], "clauses": []} == C.structure(" \n ", "d", "", "", "")


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter(text, size, overlap):
    parts = C.split(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() for p in parts)
    at = 0
    for p in parts:  # pieces of the text, in order, and nothing but blanks between them
        found = text.find(p, max(0, at - size))
        assert found >= 0
        at = found + len(p)
    assert set("".join(text.split())) == set("".join("".join(parts).split()))


def test_header_chunks():
    rows = C.by_headers("# Chương I\nmở\n### Điều 1. A\nx\n```\n# không\n```\n#### Khoản 1\ny")
    assert [(r["Chuong"], r["Dieu"], r["Khoan"], r["content"].split("\n")[0]) for r in rows] == [("Chương I", "", "", "mở"), ("Chương I", "Điều 1. A", "", "x"), ("Chương I", "Điều 1. A", "Khoản 1", "y")]


def test_settings():
    s = S.load({"VELLUMINE_RERANK_MIN_SCORE": "0.4", "VELLUMINE_GRAPH_ENABLED": "no", "VELLUMINE_EXTRACTION_MODE": "llm-shadow"})
    assert (s.retrieval.rerank_min_score, s.graph.graph_enabled, s.graph.extraction_mode) == (0.4, False, "llm_shadow")
    assert S.load({}) == S.Settings()
    with pytest.raises(ValueError):
        S.load({"VELLUMINE_CHUNK_OVERLAP": "1000"})
