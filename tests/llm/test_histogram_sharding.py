import zlib

from vellumine.llm import histogram_sharding as h

SCHEMA = "doc_id long, text string, shard string, slot int, bin string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 7, "b") for d, t in rows], SCHEMA)


def check_law(rows, n, slack):
    """rows: (size, shard, slot)."""
    assert {r[1] for r in rows} <= set(range(n))
    for s in range(n):
        assert sorted(r[2] for r in rows if r[1] == s) == list(range(sum(r[1] == s for r in rows)))
    total = sum(r[0] for r in rows)
    for s in range(n):
        assert abs(sum(r[0] for r in rows if r[1] == s) - total / n) <= slack


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "same text " * 9) for i in range(700)] + [(1000 + i, f"text {i} é" * (1 + i % 40)) for i in range(900)] + [(None, None), (5, ""), (None, "x")]
    out = h.shards(frame(spark, rows), 8)
    assert out.columns == ["doc_id", "text", "shard", "slot", "bin", "_shard", "_slot"]
    got = out.collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and r.text) == sorted((d, t) for d, t in rows if d is not None and t)
    largest = max(16 + len((t or "").encode()) for _, t in rows)
    check_law([(16 + len((r.text or "").encode()), r._shard, r._slot) for r in got], 8, 2 * largest)


def test_few_rows_repeats_and_empty(spark):
    assert h.shards(frame(spark, []), 4).collect() == []
    got = h.shards(frame(spark, [(1, "a")] * 5), 4).collect()
    check_law([(17, r._shard, r._slot) for r in got], 4, 2 * 17)
    assert len(h.shards(frame(spark, [(1, None)]), 1).collect()) == 1


def test_repeated_rows_spread(spark):
    """Equal rows, and rows without an id, meet the law like others."""
    rows = [(1, "again " * 5)] * 1000 + [(None, "nobody's")] * 500 + [(10 + i, f"own {i}") for i in range(1000)]
    got = h.shards(frame(spark, rows), 8).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((d or 0, t) for d, t in rows)
    check_law([(16 + len(r.text), r._shard, r._slot) for r in got], 8, 2 * 46)


def test_no_leaf_is_large(spark, tmp_path):
    """2 % of the rows share a text: no leaf has more than a few of the LEAVES-ths."""
    rows = [(i, "a frequent text") for i in range(2000)] + [(10_000 + i, f"t{i}") for i in range(98_000)]
    df = frame(spark, rows)
    hi, mix = h._keys(df.doc_id, df.text)
    keys = df.select(hi.alias("hi"), mix.alias("mix"), h.size_of(df.text).alias("size"))
    bits, cuts, parts = h.plan(keys, str(tmp_path))
    dealt = h.deal(keys.withColumn("bin", h._above("hi", bits)), cuts, parts)
    sizes = [r["b"] for r in dealt.groupBy("shard", "bin", "part").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert max(sizes) <= 4 * sum(sizes) / h.LEAVES and len(sizes) >= h.LEAVES


def test_very_long_text(spark):
    rows = [(0, "long " * 400_000)] + [(i, f"t{i}") for i in range(1, 200)]
    got = h.shards(frame(spark, rows), 4).collect()
    assert len(got) == 200 and {r.doc_id for r in got} == set(range(200))


def test_equal_texts_stand_together(spark):
    rows = [(i, f"t{i % 50}") for i in range(500)]
    got = h.shards(frame(spark, rows), 5).collect()
    assert sum(len({r._shard for r in got if r.text == f"t{k}"}) > 1 for k in range(50)) <= 4


def test_splitters_need_several_probes(spark, monkeypatch):
    monkeypatch.setattr(h, "PART_BITS", 3)
    rows = [(i, "one") for i in range(4000)]
    got = h.shards(frame(spark, rows), 16).collect()
    check_law([(19, r._shard, r._slot) for r in got], 16, 2 * 19)


def test_query(spark):
    got = h.op4_histogram_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.size == 16 + len(docs[r.doc_id].encode()) for r in got)
    check_law([(r.size, r.shard, r.slot) for r in got], 40, 2 * max(r.size for r in got))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_nothing_runs_in_python(spark):
    plan = h.op4_histogram_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
