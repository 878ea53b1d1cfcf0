"""DataFrame operators on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators import answers as A
from vellumine.operators import chunking as C
from vellumine.operators import context as N
from vellumine.operators import evaluation as E
from vellumine.operators import facts as K
from vellumine.operators import graph as G
from vellumine.operators import retrieval as R
from vellumine.operators import vector_index as V
from vellumine.plans import pipeline as L
from vellumine.sources import files
from vellumine.sources import html as H
from vellumine.sources import registry as Reg
from vellumine.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(X.slug(lit("Nghị định A"), lit("145/2020/NĐ-CP"))) == "145-2020-nd-cp-nghi-dinh-a" and v(X.slug(lit(None))) == "vbpl-document"
    assert v(X.api_date(lit("2020-12-14T00:00:00"))) == "14/12/2020" and v(X.api_date(lit(" a  b "))) == "a b" and v(X.api_date(lit(None))) == ""
    assert v(X.number_from_source(lit("d\\145-2020-nd-cp-nghi-dinh-quy-dinh.md"))) == "145/2020/ND-CP" and v(X.number_from_source(lit("x.md"))) == ""
    assert v(X.id_from_url(lit("https://a/b/ten--123"))) == "123" and v(X.id_from_url(lit("https://a/p.aspx?x=1&ItemID=7"))) == "7" and v(X.id_from_url(lit("https://a/b"))) == ""
    assert v(X.detail_url(lit("https://a/vbpq-thuoctinh.aspx?x=1&ItemID=7"))) == "https://a/vbpq-toanvan.aspx?ItemID=7"
    assert v(X.ascii_key(lit("Điều  LUẬT"))) == "ieu luat" and v(X.search_key(lit("Điều  LUẬT"))) == "dieu luat"
    assert v(X.contains_keyword(lit("LAO ĐỘNG"), lit("lao dong"))) and not v(X.contains_keyword(lit("x"), lit("")))
    long = v(X.compact(F.repeat(lit("từ "), 500)))
    assert len(long) <= 1203 and long.endswith("từ...") and v(X.compact(F.repeat(lit("x"), 1300))) == "x" * 1200 + "..."
    assert v(X.source_span(lit("a\nb\nc d"), lit("b\nc"))) == "L2-L3" and v(X.source_span(lit("a"), lit("z"))) == ""
    assert v(X.quoted_replacement(lit("x “a “b” c” d"))) == "a “b” c"
    assert [v(X.operation(lit(s))) for s in ("Sửa đổi, bổ sung", "Bổ sung", "bãi bỏ", "Thay thế")] == ["amend", "supplement", "repeal", "replace"]
    assert v(X.infer_type(lit("xem Bộ luật Lao động"))) == "Bộ luật" and v(X.infer_status(lit("CÒN HIỆU LỰC"))) == "Còn hiệu lực"
    assert v(X.detail_metadata(lit("Số hiệu: 1/2020/X Người ký: Ông A Ngày ban hành: 1/2/2020")))["so_ky_hieu"] == "1/2020/X"
    assert v(X.strip_preamble(lit("đầu\n### Điều 1. x\ny"))) == "### Điều 1. x\ny" and v(X.strip_comment_lines(lit("<!-- a -->\nb"))) == "b"
    assert v(X.strip_code_fence(lit("```json\n{}\n```"))) == "{}" and v(X.string_list(lit('["a"]'))) == ["a"] and v(X.string_list(lit("a"))) == ["a"]
    assert v(X.is_generic_law(lit("theo pháp luật Việt Nam"))) and not v(X.is_generic_law(lit("Luật Đất")))
    assert v(X.looks_legal(F.concat(lit("Điều 1 "), F.repeat(lit("x"), 60)))) and not v(X.looks_legal(lit("Điều 1")))


def test_fusion(spark):
    rows = [(1, "A", "semantic", 1, 0.1), (1, "B", "semantic", 2, 0.2), (1, "B", "bm25", 1, 9.0), (1, "C", "bm25", 2, 8.0)]
    got = R.fuse(spark.createDataFrame(rows, "query_id int, chunk_id string, source_retriever string, original_rank int, raw_score double")).orderBy("retrieval_rank").collect()
    assert [(r["chunk_id"], round(r["fused_score"], 9)) for r in got] == [("B", round(1 / 62 + 1 / 61, 9)), ("A", round(1 / 61, 9)), ("C", round(1 / 62, 9))]
    tie = R.fuse(spark.createDataFrame([(1, "z", "semantic", 1, 0.0), (1, "a", "bm25", 1, 0.0)], "query_id int, chunk_id string, source_retriever string, original_rank int, raw_score double"))
    assert [r["chunk_id"] for r in tie.orderBy("retrieval_rank").collect()] == ["z", "a"]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "q", c, str(s), i) for i, (c, s) in enumerate([("a", 0.9), ("b", 0.2), ("c", 0.8)])], "query_id int, query string, chunk_id string, content string, retrieval_rank int")
    got = R.rerank(rows, lambda q, t: t.cast("double"), 5, 0.5).orderBy("rerank_rank").collect()
    assert [(r["chunk_id"], r["rerank_rank"]) for r in got] == [("a", 1), ("c", 2)]


def test_dense_blocks_and_edges(spark):
    vecs = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(50)] + [(99, None, 0), (98, [1.0], 0)], "chunk_id int, embedding array<float>, label int")
    asked = spark.createDataFrame([(q, [float(q), 0.0], q % 2) for q in (3, 10, 49)] + [(7, None, 1)], "query_id int, embedding array<float>, want int")
    whole = sorted(R.dense(asked, vecs, 3).collect())
    assert [(r["query_id"], r["chunk_id"], r["original_rank"], r["raw_score"]) for r in whole if r["query_id"] == 10] == [(10, 9, 2, 1.0), (10, 10, 1, 0.0), (10, 11, 3, 1.0)]
    assert whole == sorted(R.dense(asked, vecs, 3, block=1).collect())
    assert {r["chunk_id"] % 2 for r in R.dense(asked, vecs, 3, match=("want", "label")).filter("query_id = 10").collect()} == {0}
    assert R.dense(asked.filter("false"), vecs).count() == 0 and R.dense(asked, vecs.filter("false")).count() == 0


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    asked, v = rng.integers(0, 4, (7, 3)).astype(float), rng.integers(0, 4, (400, 3)).astype(float)
    for size in (1, 7, 400):
        near = R.Nearest(asked, 5)
        for i in range(0, 400, size):
            near.show(v[i : i + size], list(range(i, min(400, i + size))))
        d = ((asked[:, None] - v[None]) ** 2).sum(axis=2)
        edge = np.sort(d, axis=1)[:, 4]
        want = {(q, x) for q, x in zip(*np.nonzero(d <= edge[:, None]), strict=True)}
        assert set(zip(near.who.tolist(), near.ids, strict=True)) == want and np.allclose(near.far, d[near.who, near.ids])


def test_vector_index(spark, tmp_path):
    """Every vector is indexed; visiting all cells is exact, visiting some finds 0.9 of the neighbours of clustered vectors."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 8)) * 4
    vecs = [(i, (centre[i % 20] + rng.normal(size=8)).tolist(), "own") for i in range(1500)] + [(2000 + i, centre[0].tolist(), "own") for i in range(500)] + [(5000, None, "own"), (5001, [1.0], "own")]
    df = spark.createDataFrame(vecs, "chunk_id long, embedding array<float>, `cells` string")
    V.write(df, str(tmp_path), 32)
    index, centres = V.open_index(spark, str(tmp_path))
    assert index.count() == 2000 and "cells" in index.columns
    asked = df.filter("chunk_id % 20 = 0 AND chunk_id < 5000").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = R.dense(asked, df)
    whole = V.search(asked, index, centres, probes=32, block=40)
    key = lambda rows: sorted((r["query_id"], r["original_rank"], r["chunk_id"]) for r in rows.collect())
    assert key(whole) == key(exact)
    got = V.recall(V.search(asked, index, centres, probes=8), exact).first()
    assert got["n_questions"] == 100 and got["recall"] >= 0.9
    none = spark.createDataFrame([], df.schema)
    assert V.fit(none).shape[0] == 0 and V.search(asked, V.assigned(none, V.fit(none)), V.fit(none)).count() == 0


def test_bm25_pruning_changes_nothing(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(800)]
    df = spark.createDataFrame(docs, "chunk_id long, content string")
    posts, stats = R.postings(df).cache(), R.corpus_stats(df)
    terms = R.term_stats(posts, stats).cache()
    asked = df.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text"))
    key = lambda rows: sorted((r["query_id"], r["original_rank"], r["chunk_id"], round(r["raw_score"], 8)) for r in rows.collect())
    for k in (1, 15):
        assert key(R.bm25(asked, posts, terms, stats, k)) == key(R.bm25(asked, posts, terms, stats, k, folder=str(tmp_path / str(k))))
    assert terms.filter("idf < 0").count() == 0
    odd = terms.withColumn("idf", F.when(F.length("term") == 2, -0.3).otherwise(F.col("idf")))  # weights below zero too
    assert key(R.bm25(asked, posts, odd, stats, 3)) == key(R.bm25(asked, posts, odd, stats, 3, folder=str(tmp_path / "odd")))
    posts.unpersist(), terms.unpersist()


def test_bm25_in_blocks(spark, tmp_path, monkeypatch):
    """Bags have the postings' rows; several blocks, matrices and lists give the joined plan's rows; copies tie by id."""
    rng = random.Random(5)
    words, weights = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    docs = [(f"c{i:04}", " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(1500)] + [(f"x{i}", "w1 w9 w9 w44") for i in range(60)] + [("y", None)]
    df = spark.createDataFrame(docs, "chunk_id string, content string").repartition(3)
    bags, posts, stats = R.bags(df).cache(), R.postings(df).cache(), R.corpus_stats(df)
    each = bags.select("chunk_id", "length", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).select(posts.columns)
    assert sorted(each.collect()) == sorted(posts.collect())
    terms = R.term_stats(bags, stats).cache()
    assert {(r["term"], r["df"]) for r in terms.collect()} == {(r["term"], r["df"]) for r in R.term_counts(df).collect()}
    asked = df.filter("chunk_id LIKE 'c%0' OR chunk_id = 'x7'").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("text"))
    key = lambda rows: sorted((r["query_id"], r["original_rank"], r["chunk_id"], round(r["raw_score"], 8)) for r in rows.collect())
    want = key(R.bm25(asked, posts, terms, stats, 5))
    assert [x[2] for x in want if x[0] == "x7"] == ["x0", "x1", "x10", "x11", "x12"]
    monkeypatch.setattr(R, "SPARSE_BLOCK", 70)
    monkeypatch.setattr(R, "ROWS", 100)
    for dense, spread in ((1024, 10**6), (3, 200), (0, 10**6)):
        monkeypatch.setattr(R, "DENSE_TERMS", dense)
        monkeypatch.setattr(R, "SPREAD", spread)
        assert key(R.bm25(asked, bags, terms, stats, 5, folder=str(tmp_path / f"{dense}"))) == want
    assert R.bm25(asked.filter("false"), bags, terms, stats, 5, folder=str(tmp_path / "none")).count() == 0
    [x.unpersist() for x in (bags, posts, terms)]


def test_best_keeps_few_of_many_copies():
    """Equal scores don't pile up: the least ids stay."""
    import numpy as np
    import pyarrow as pa

    best = R.Best(2, 3)
    for a in range(0, 1000, 100):
        best.show(np.full((100, 2), [5.0, 0.0]), pa.array([f"{999 - a - i:03}" for i in range(100)]))
        best.show(np.array([[1.0, 7.0 - a / 1000]]), pa.array([f"z{a:03}"]))
    rows = best.rows(pa.array([10, 20]), pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("raw_score", pa.float64())])).to_pylist()
    assert [tuple(r.values()) for r in rows] == [(10, "000", 5.0), (10, "001", 5.0), (10, "002", 5.0), (20, "z000", 7.0), (20, "z100", 6.9), (20, "z200", 6.8)]


def test_scoped_search(spark):
    """Chunks of a scope's document by number; else by a name that the title holds, of any length."""
    chunks = [(i, [float(i)], n, t) for i, (n, t) in enumerate([("1/2020/X", "Luật Một"), ("1/2020/x ", "Luật Một"), ("", "Bộ luật Lao động sửa đổi"), ("", "Luật Đất đai 2013"), (None, None), ("", "ab")])]
    vecs = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, doc_number string, title string")
    asked = spark.createDataFrame([(1, [0.9]), (2, [9.0])], "query_id int, embedding array<double>")
    scopes = [(1, 1, "1/2020/X", "Luật Một"), (1, 2, "", "Lao động"), (2, 1, "9/9999/Y", "Đất đai"), (2, 2, "", "Không có"), (2, 3, "", "b")]
    got = R.scoped(asked, spark.createDataFrame(scopes, "query_id int, pos int, doc_number string, title_hint string"), vecs).collect()
    assert sorted((r["query_id"], r["scope_rank"], r["chunk_id"]) for r in got) == [(1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 1, 3), (2, 2, 5)]
    assert [r["chunk_id"] for r in R.scoped(asked, spark.createDataFrame(scopes, "query_id int, pos int, doc_number string, title_hint string"), vecs, limit=1).orderBy("query_id").collect()] == [1, 3]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("x", "a b b"), ("y", "a c"), ("z", None), ("w", "d")], "chunk_id string, content string")
    posts, stats = R.postings(docs), R.corpus_stats(docs)
    got = R.bm25(spark.createDataFrame([(1, "b b q"), (2, "")], "query_id int, text string"), posts, R.term_stats(posts, stats), stats).collect()
    import math

    idf, avgdl = math.log(4 - 1 + 0.5) - math.log(1.5), 6 / 4
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert len(got) == 1 and got[0]["chunk_id"] == "x" and abs(got[0]["raw_score"] - want) < 1e-9


def test_python_takes_few_rows_at_a_time(spark, monkeypatch):
    """Rows pass in parts, whole and in order; a column of the same name is replaced; columns by Arrow come in parts too."""
    from pyspark.sql import types as T

    monkeypatch.setattr(C, "PARTS", 3)
    monkeypatch.setattr(C, "ROWS", 4)
    df = spark.createDataFrame([(i, None if i == 5 else f"t{i}", "old") for i in range(11)], "i int, t string, n string").coalesce(1)
    kinds = {"n": T.LongType(), "l": T.ArrayType(T.StringType())}
    made = C.with_parts(df, kinds, ("t", "i"), lambda t, i: (i * 2, [t, "x"]))
    assert made.columns == ["i", "t", "n", "l"] and [tuple(r) for r in made.collect()] == [(i, t, 2 * i, [t, "x"]) for i, t, _ in df.collect()]
    assert C.with_parts(df.filter("false"), kinds, ("t", "i"), lambda t, i: (i, [t])).count() == 0
    up = C.arrow(T.StringType())(lambda t: t and t.upper())
    assert [r[0] for r in df.select(up("t")).collect()] == [None if i == 5 else f"T{i}" for i in range(11)]


def test_nearest_keeps_few_of_many_copies():
    import numpy as np

    near = R.Nearest(np.zeros((1, 2)), 3)
    for a in range(0, 500, 100):
        near.show(np.ones((100, 2)), [999 - a - i for i in range(100)])
    assert sorted(near.ids) == [500, 501, 502]


def test_documents_of_one_number(spark):
    """Own references stay in their document, others go to the first one; a question about a document means that one."""
    text = "Điều 1. Một\n1. Theo khoản 1 Điều 2.\n2. Hai.\nĐiều 2. Hai\n1. Áp dụng Điều 1 Nghị định số 7/2020/NĐ-CP."
    rows = [(i, text, n, f"Văn bản {i}") for i, n in (("9", "7/2020/NĐ-CP"), ("10", "7/2020/NĐ-CP"), ("11", "8/2020/NĐ-CP"))]
    docs = C.parsed(spark.createDataFrame(rows, "document_id string, content string, doc_number string, title string")).cache()
    links = {(r["src"], r["dst"]) for r in G.edges(K.references(docs), K.amendments(docs), K.relations(docs), docs).collect()}
    assert links == {(f"{i}:a1:c1", f"{i}:a2:c1") for i in (9, 10, 11)} | {(f"{i}:a2:c1", "9:a1") for i in (9, 10, 11)}
    asked = spark.createDataFrame([(1, "khoản 1 Điều 1 Nghị định 7/2020/NĐ-CP"), (2, "Nghị định 7/2020/NĐ-CP"), (3, "khoản 1 Điều 2 Nghị định 8/2020/NĐ-CP")], "query_id int, text string")
    anchors, units = A.query_anchors(asked), G.unit_nodes(docs)
    assert {r["unit_id"] for r in G.anchor_clauses(anchors, units).filter("query_id = 1").collect()} <= {"9:a1:c1", "10:a1:c1"}
    about = anchors.withColumn("about", F.lit("10"))
    assert sorted((r["query_id"], r["unit_id"]) for r in G.anchor_clauses(about, units).collect()) == [(1, "10:a1:c1"), (3, "11:a2:c1")]
    assert [(r["query_id"], r["title_hint"]) for r in G.anchor_scopes(about, units).collect()] == [(2, "Văn bản 10")]
    docs.unpersist()


def test_label_metrics(spark):
    """The same as with all relevant pairs, without making them."""
    items = spark.createDataFrame([(i, None if i % 7 == 0 else f"l{i % 3}") for i in range(40)], "item int, label string")
    asked = spark.createDataFrame([(q, None if q == 4 else f"l{q % 4}") for q in range(6)], "query_id int, label string")
    ranked = spark.createDataFrame([(q, (q * 5 + r * 3) % 40, r) for q in range(6) for r in range(1, 13)], "query_id int, item int, rank int")
    got = E.label_metrics(ranked, asked, items, 10)
    assert sorted(got.collect()) == sorted(E.ranking_metrics(ranked, asked.join(items, "label").select("query_id", "item"), 10).collect())
    assert got.count() == 4


def laws(spark):
    a = "Chương I\nCHUNG\nĐiều 1. Phạm vi\n1. Theo khoản 2 Điều 2.\n2. Áp dụng Điều 1 Nghị định số 2/2020/NĐ-CP.\nĐiều 2. Khác\n1. Theo Luật Đất đai.\n2. Theo Điều 8 của Nghị định này.\nĐiều 3. Sửa đổi Nghị định số 2/2020/NĐ-CP\n1. Bổ sung khoản 3 vào Điều 1\n“3. mới”\n"
    b = "Căn cứ Luật số 1/2019/QH14;\nHướng dẫn thi hành Luật số 9/2009/QH12\nĐiều 1. Một\n1. Nội dung lao động.\n10. Mười.\n2. Hai."
    rows = [("d1", a, "1/2019/QH14", "Luật", "Luật một"), ("d2", b, "2/2020/nđ-cp ", "Nghị định", "Nghị định hai"), ("d3", "", None, None, None), ("d4", "Không có tiêu đề nào.", None, None, "Thư")]
    return C.parsed(spark.createDataFrame(rows, "document_id string, content string, doc_number string, document_type string, title string"))


def test_facts_and_graph(spark):
    docs = laws(spark).cache()
    refs, amends, rels = K.references(docs), K.amendments(docs), K.relations(docs)
    assert {(r["source_clause_id"], r["scope"], r["target_document_number"], r["target_article_no"]) for r in refs.collect()} == {
        ("d1:a1:c1", "same_document", "1/2019/QH14", "2"), ("d1:a1:c2", "external_document", "2/2020/NĐ-CP", "1"), ("d1:a2:c1", "external_document", "", ""),
    }
    assert K.clause_references(docs).count() == 4  # one points beyond the last article, with a marker
    assert [(r["operation_type"], r["target_document_number"], r["new_text"]) for r in amends.collect()] == [("supplement", "2/2020/NĐ-CP", "3. mới")]
    assert {(r["source_document_id"], r["relation_type"], r["target_document_number"]) for r in rels.collect()} == {("d1", "AMENDS", "2/2020/NĐ-CP"), ("d2", "BASED_ON", "1/2019/QH14"), ("d2", "GUIDES", "9/2009/QH12")}
    links = G.edges(refs, amends, rels, docs)
    assert {(r["src"], r["rel"], r["dst"]) for r in links.collect()} == {
        ("d1:a1:c1", "REFERS_TO", "d1:a2:c2"), ("d1:a1:c2", "REFERS_TO", "d2:a1"), ("d1:a2:c1", "REFERS_TO", "docref:luật đất đai"), ("d1:a3:c1", "SUPPLEMENTS", "d2:a1:c3"),
        ("d1", "AMENDS", "d2"), ("d2", "BASED_ON", "d1"), ("d2", "GUIDES", "docref:9/2009/QH12"),
    }
    units = G.nodes(docs, links)
    by = {r["unit_id"]: r for r in units.collect()}
    assert units.count() == len(by)
    assert by["d1:a2:c2"]["text"] == "Theo Điều 8 của Nghị định này." and by["d2:a1:c3"]["text"] == "" and not by["docref:luật đất đai"]["resolved"]
    seeds = spark.createDataFrame([(1, 1, "d1:a1:c2", "d1", "", ""), (2, 1, "", "d1", "2", "2"), (3, 1, "nothing", "", "", "")], "query_id int, pos int, unit_id string, document_id string, article_no string, clause_no string")
    near = {(r["query_id"], r["unit_id"], r["graph_direction"]) for r in G.related_clauses(seeds, units, links).collect()}
    assert near == {(1, "d2:a1:c1", "outgoing"), (1, "d2:a1:c10", "outgoing"), (1, "d2:a1:c2", "outgoing"), (1, "d2:a1:c3", "outgoing"), (2, "d1:a1:c1", "incoming")}
    asked = spark.createDataFrame([(1, "Điều 1 Nghị định 2/2020/NĐ-CP"), (2, "Luật 1/2019/QH14 và Luật 5/2005/QH11")], "query_id int, text string")
    got = G.anchor_clauses(A.query_anchors(asked), G.unit_nodes(docs)).orderBy("pos").collect()
    assert [r["unit_id"] for r in got] == ["d2:a1:c1", "d2:a1:c2", "d2:a1:c10"]  # in numeric order
    assert [(r["doc_number"], r["title_hint"]) for r in G.anchor_scopes(A.query_anchors(asked), units).orderBy("pos").collect()] == [("1/2019/QH14", "Luật một"), ("5/2005/QH11", "")]
    with pytest.raises(Exception, match="unsupported relation"):
        G.check_relations(links.withColumn("rel", F.lit("HATES"))).collect()
    row = K.audit(docs, refs, amends, rels, K.clause_references(docs)).first()
    assert row["documents_seen"] == 4 and row["same_document_refs_blocked_by_max_article"] == 1 and row["relations_by_type"] == {"AMENDS": 1, "BASED_ON": 1, "GUIDES": 1, "REFERENCE": 3, "SUPPLEMENTS": 1}


def test_model_facts(spark):
    docs = laws(spark).filter("document_id = 'd1'").withColumn("source_url", F.lit("https://vbpl.vn/x"))
    fact = {"raw_text": "Điều 8", "confidence": 0.9, "evidence_text": "Theo  Điều 8 của Nghị định này.", "source_article_no": "2"}
    facts = [fact, fact | {"confidence": 0.5}, fact | {"evidence_text": "không có"}, fact | {"target_title_hint": "pháp luật"}]
    raw = "```json\n" + json.dumps({"references": facts}, ensure_ascii=False) + "\n```"
    asked = K.should_call(docs, K.clause_references(docs), K.document_relations(docs))
    pay = K.model_payloads(asked, lambda title, text, units: F.lit(raw))
    rows = K.model_facts(docs, pay, "references")
    assert [r["verdict"] for r in rows.orderBy("pos").collect()] == ["accepted", "low_confidence", "missing_evidence", "generic_law"]
    got = K.model_references(rows).first()
    assert (got["source_clause_id"], got["extraction_method"]) == ("d1:a2:c1", "llm") and got["ref_type"] == "external_document"
    for bad in ("nothing", "[1]", '{"amendments": [{"raw_text": "a", "evidence_text": "b", "operation_type": "destroy"}]}', '{"references": [{"raw_text": "a", "evidence_text": "b", "confidence": 2}]}'):
        assert value(spark, K.parse_payload(F.lit(bad))) is None
    assert value(spark, K.parse_payload(F.lit("{}"))) is not None


def test_contexts(spark):
    main = spark.createDataFrame([(1, i, f"c{i}", "d", f"text {i}") for i in range(1, 9)], "query_id int, pos int, chunk_id string, document_id string, content string")
    graph = spark.createDataFrame([(1, 1, "u1", "d", "text 1", "query_anchor"), (1, 2, "u2", "e", "rel", "graph_direct_incoming"), (1, 3, "u3", "e", "", "graph_direct_incoming")], "query_id int, pos int, unit_id string, document_id string, content string, graph_source string")
    packed = N.pack(main, graph, rerank_k=8)
    assert [r["content"] for r in packed.orderBy("pos").collect()] == [f"text {i}" for i in range(1, 7)] + ["rel"]
    got = N.contexts(spark.createDataFrame([(1, "q"), (2, "none")], "query_id int, text string"), packed).orderBy("query_id").collect()
    assert len(got[0]["dq_context_list"]) == 6 and got[0]["gq_context"].startswith("--- Gq QUAN HE SO 1 ---\n[Nguon]: Neo4j graph\n[Loai nguon]: graph_direct_incoming\n")
    assert got[1]["dq_context"] == "" and got[1]["gq_context_list"] == []
    one = spark.createDataFrame([(1, 1, "a/145-2020-nd-cp-nghi-dinh.md", "5", "0", "t")], "query_id int, pos int, source string, article_no string, clause_no string, content string")
    body = N.contexts(spark.createDataFrame([(1, "q")], "query_id int, text string"), N.shaped(one)).first()["dq_context"]
    assert body == "--- Dq TAI LIEU SO 1 ---\n[Nguon]: 145-2020-nd-cp-nghi-dinh.md\n[Van ban]: 145/2020/ND-CP\n[Dieu]: Điều 5\n[Trich dan]: Điều 5\n[Noi dung]: t"


def test_verification(spark):
    rows = [("Khoản 1 Điều 2 nói vậy", "có KHOẢN 1  điều 2"), ("không", "x"), ("Điều 77", "x"), ("", "x"), (None, None), ("Điều 1", "Điều 10"), ("Luật số 1/2020/QH14", "số 1/2020/QH14")]
    df = spark.createDataFrame([(i, a, d, "") for i, (a, d) in enumerate(rows)], "i int, answer string, dq_context string, gq_context string")
    got = [r["verification_result"]["fallback_reason"] for r in A.with_verification(df).orderBy("i").collect()]
    assert got == ["", "missing_citation", "unsupported_citation", "", "", "", ""]
    strict = [r["verification_result"]["fallback_reason"] for r in A.with_verification(df, whole_words=True).orderBy("i").collect()]
    assert strict[5] == "unsupported_citation" and strict[0] == ""


def test_registry(spark):
    rows = [("1", "a", "A.md", 1, 5), ("2", "b", "B.md", 1, 6)]
    reg = spark.createDataFrame(rows, "document_id string, title string, markdown_path string, seq long, content_bytes long").select(
        "document_id", "title", "markdown_path", "seq", "content_bytes", F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("json_path"), F.lit(None).cast("string").alias("content_sha256"),
        F.lit("crawled").alias("crawl_status"), F.lit(None).cast("string").alias("error"),
    )
    up = Reg.upsert(reg, reg.filter("document_id = '2'").withColumn("title", F.lit("new")).withColumn("seq", F.lit(2).cast("long")))
    assert sorted((r["document_id"], r["title"]) for r in up.collect()) == [("1", "a"), ("2", "new")]
    bad = Reg.error_upsert(up, spark.createDataFrame([("2", "boom", 3), ("3", "gone", 3)], "document_id string, error string, seq long"))
    assert sorted((r["document_id"], r["crawl_status"], r["markdown_path"], r["error"]) for r in bad.collect()) == sorted([("1", "crawled", "A.md", None), ("2", "error", "B.md", "boom"), ("3", "error", None, "gone")], key=str)
    found = Reg.lookup(spark.createDataFrame([("x/A.md",), ("root/b.md",), ("zzz",)], "path string"), reg, "root")
    assert {r["path"]: r["registry"] and r["registry"]["document_id"] for r in found.collect()} == {"x/A.md": "1", "root/b.md": "2", "zzz": None}
    meta = spark.createDataFrame([("1", "", '{"metadata": {"title": "nested", "so_ky_hieu": "9"}}')], "document_id string, title string, metadata_json string")
    row = Reg.metadata(meta).first()
    assert (row["title"], row["doc_number"]) == ("nested", "9")


def test_api_items(spark, tmp_path):
    pages = {1: {"data": {"items": [{"id": "1", "title": "Luật  A", "docType": {"name": "Luật"}, "issueDate": "2020-01-02"}, {"id": "2", "title": "B", "docType": {"name": "Quyết định"}}], "total": 3}}, 2: {"items": [{"id": "1", "title": "Luật A", "docType": {"name": "Luật"}}], "total": 3}}
    Reg.write_pages(Reg.api_pages(pages.__getitem__, size=2), spark, str(tmp_path / "api"))
    items = Reg.read_pages(spark, str(tmp_path / "api")).select(F.inline("items"))
    assert items.count() == 3
    got = Reg.search_results(items).collect()
    assert [(r["document_id"], r["title"], r["source_url"]) for r in got] == [("1", "Luật A", "https://vbpl.vn/van-ban/trung-uong/luat-a--1")]


def test_html(spark):
    page = "<html><title>T</title><body><nav>menu</nav><div id=toanvan><h2>Điều 1. Đầu</h2><p>a <b>x</b> c</p><script>bad()</script><table><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr></table><ol><li>m</li><li>n</li></ol>" + "chữ " * 20 + "</div></body></html>"
    row = H.parsed_pages(spark.createDataFrame([(page,), (None,)], "html string")).select("page.*", H.blocks_markdown("page.blocks").alias("m")).collect()
    assert row[0]["m"].startswith("## Điều 1. Đầu\n\na x c\n\n| h |  |\n| --- | --- |\n| 1 | 2 |\n\n1. m\n2. n\n")
    assert row[1]["blocks"] == [] and row[1]["m"] == ""
    listing = "<div><h3>Luật Đất đai</h3><a href='/van-ban/luat-dat-dai--55'>xem</a> Trạng thái: Còn hiệu lực</div>"
    got = H.search_results(spark.createDataFrame([(listing,)], "html string"), base="https://vbpl.vn").first()
    assert (got["document_id"], got["title"], got["document_type"], got["status"]) == ("55", "Luật Đất đai", "Luật", "Còn hiệu lực")
    assert H.has_next("<a>2</a>", 1) and not H.has_next("<a>2</a>", 2) and H.has_next("<a>Sau</a>", 9)


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "Có"), (2, "Không trả lời được vì"), (3, " ")], "query_id int, ground_truth string")
    assert [r["query_id"] for r in E.scored(rows).collect()] == [1]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, item string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id int, item string")
    got = {r["query_id"]: (r["recall"], r["reciprocal_rank"]) for r in E.ranking_metrics(ranked, truth, 5).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}


def test_whole_chain(spark, tmp_path):
    docs = laws(spark).select("document_id", "content", "doc_number", "document_type", "title")
    index = L.build(docs, folder=str(tmp_path / "build")).write(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "khoản 1 Điều 1 Nghị định 2/2020/NĐ-CP về lao động"), (2, "zzz")], "query_id int, text string")
    rows = {r["query_id"]: r for r in L.answer(asked, index, folder=str(tmp_path / "a")).collect()}
    assert rows[1]["verification_result"]["passed"] and "Nội dung lao động." in rows[1]["dq_context"]
    lazy = {r["query_id"]: r["answer"] for r in L.answer(asked, index).collect()}
    assert lazy == {k: r["answer"] for k, r in rows.items()}
    means = E.means(L.evaluate(asked, spark.createDataFrame([(1, "Nội dung lao động.")], "query_id int, ground_truth string"), index)).first()
    assert 0 <= means["faithfulness"] <= 1 and means["context_recall"] > 0


def test_folders_and_streams(spark, tmp_path):
    (tmp_path / "md" / "x").mkdir(parents=True)
    (tmp_path / "md" / "x" / "a.md").write_text("Điều 1. A\n1. b", encoding="utf-8")
    (tmp_path / "md" / "b.md").write_text("", encoding="utf-8")
    assert [r["content"] for r in files.markdown_folder(spark, str(tmp_path / "md")).collect()] == ["Điều 1. A\n1. b"]
    q = ingest.markdown_stream(spark, str(tmp_path / "md")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").filter("content != ''").count() == 1
    src = tmp_path / "rows"
    spark.createDataFrame([("1", "u", "a", 1), ("1", "u", "b", 2)], "document_id string, source_url string, title string, seq long").write.parquet(str(src))
    stream = spark.readStream.schema("document_id string, source_url string, title string, seq long").parquet(str(src))
    ingest.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["b"]
    more = [(str(i), "u", f"t{i}", 3) for i in range(40)] + [("1", "u", "late", 0)]
    spark.createDataFrame(more, "document_id string, source_url string, title string, seq long").write.mode("append").parquet(str(src))
    old = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    ingest.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    got = {r["document_id"]: r["title"] for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {str(i): f"t{i}" for i in range(40)} and len(old) == 1
    assert files.registry_path("/a/b", None, lambda p: p == "/a/registry.parquet") == "/a/registry.parquet"
