import random

import corpus_pipeline
from vellumine.llm.decontam_qgram import Index
from vellumine.llm.histogram_sharding import N_SHARDS
from vellumine.llm.mixing_ipf import weighted
from vellumine.llm.quality_rules import POLICIES, PRODUCTION_POLICY, RULES, mask, measure
from vellumine.llm.simhash_golay import fingerprints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def corpus(spark):
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, text(1), "de", "hot") for i in range(40)] + [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "few words", "en", "s1"), (None, text(777), "en", "s1"), (None, text(777), "en", "s1")]
    rows += [(400, text(5) + " " + text("item", 20) + " " + text(6), "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def rejected(t):
    m = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"), measure(t), strict=True))
    bits = sum(1 << k for k, rule in enumerate(RULES.values()) if eval(rule, {}, m))  # noqa: S307
    return bool(bits & mask(POLICIES[PRODUCTION_POLICY]))


def brute(rows, item):
    rows = [r for r in rows if not rejected(r["text"])]
    prints = [int(x) for x in fingerprints(r["text"] for r in rows)]
    groups = []
    for k, p in enumerate(prints):
        near = [g for g in groups if any((p ^ prints[j]).bit_count() <= 2 for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [k]]
    rows = [min((rows[k] for k in g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups]
    return [r for r in rows if not Index([(1, item)]).find([r["text"]])[0]]


def test_stages(spark, tmp_path):
    item = text("item", 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = brute(docs.collect(), item)
    df = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
    assert sorted(map(str, df.collect())) == sorted(map(str, clean))
    mixed, m = weighted(spark.createDataFrame(clean, SCHEMA))
    want = sorted(str(r["doc_id"]) for r in mixed.filter(f"{m}.selected").collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(str(r["doc_id"]) for r in got) == want
    for s in range(N_SHARDS):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_clashing_columns_and_repeats(spark, tmp_path):
    rows = [(i, text(i), "en", f"s{i % 3}", 1, "own", 9) for i in range(40)] + [(3, text(3), "en", "s0", 1, "own", 9)] * 2
    spark.createDataFrame([(1, text("item", 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA + ", shard string, mix int").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "mix", "_shard", "slot"]
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) > 25 and {r.shard for r in out.collect()} == {"own"}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
