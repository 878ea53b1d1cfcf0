import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import topics
from vellumine.llm.mixing_ipf import KEEP, NULL, TEMPERATURE, cell_weights, level, op6_mixing_ipf, rake, sample, weighted

SCHEMA = "doc_id long, text string, source string, lang string, mix string"


def docs(spark, n=600):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        s = "big" if rng.random() < 0.7 else f"s{int(rng.integers(4))}"
        own = rng.choice([f"t{i % 3}w{k}" for k in range(40)], int(rng.integers(1, 300)))
        rows.append((i, " ".join(own), s, ["en", "de"][int(rng.integers(2))], "own"))
    return spark.createDataFrame(rows, SCHEMA)


def test_marginals_hold(spark):
    targets = {"source": {"big": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1}, "lang": {"en": 3, "de": 1}}
    out, m = weighted(docs(spark), targets)
    assert m != "mix"
    rows = out.selectExpr("source", "lang", f"{m}.n_tokens * {m}.weight AS w").toPandas()
    by = rows.groupby("source").w.sum() / rows.w.sum()
    assert np.allclose(by, 0.2, atol=1e-6)
    by = rows.groupby("lang").w.sum() / rows.w.sum()
    assert abs(by["en"] - 0.75) < 1e-6


def test_table_and_driver_agree(spark):
    narrow = weighted(docs(spark))[0].selectExpr("source", "lang", "_mix.topic AS topic", "_mix.n_tokens AS n_tokens")
    key = lambda r: (r["source"], r["lang"], r["topic"])
    a = {key(r): (r["weight"], r["p"]) for r in cell_weights(narrow).collect()}
    b = {key(r): (r["weight"], r["p"]) for r in cell_weights(narrow, max_cells=0).collect()}
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], rtol=1e-6) for k in a)


def test_expected_tokens(spark):
    out, m = weighted(docs(spark), keep=0.5)
    r = out.selectExpr(f"sum({m}.n_tokens) AS n", f"sum({m}.n_tokens * {m}.probability) AS e").first()
    assert abs(r["e"] / r["n"] - 0.5) < 1e-6
    own = docs(spark)
    got = sample(own, keep=0.5)
    assert got.columns == own.columns and 0 < got.count() < own.count()
    assert sorted(got.collect()) == sorted(sample(own.repartition(3), keep=0.5).collect())


def test_defined_cases(spark):
    rows = [(None, None, None, None, None), (1, "", "a", "en", "x"), (1, "", "a", "en", "x"), (2, "one two", None, "en", None), (3, "w " * 5000, "b", None, None)]
    out, m = weighted(spark.createDataFrame(rows, SCHEMA))
    got = out.collect()
    assert len(got) == 5 and {r[m]["topic"] for r in got if not r["text"]} == {"none"} != {r[m]["topic"] for r in got if r["text"]}
    assert {r[m]["n_tokens"] for r in got} == {0, 2, 5000}
    assert all(r[m]["probability"] is not None for r in got)
    assert weighted(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert NULL not in {r["source"] for r in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.sampled_from("pq"), st.integers(1, 1000)), min_size=1, max_size=12, unique_by=lambda c: c[:3]), st.floats(0.1, 0.95))
def test_level(cells, keep):
    n, (w, _) = np.array([c[3] for c in cells], float), rake(cells)
    assert (w >= 0).all()
    f = level(n, w, keep)
    assert abs((n * np.minimum(1, f * w)).sum() - keep * n.sum()) < 1e-6 * n.sum()


def test_rows_without_an_id_draw_apart(spark):
    own = spark.createDataFrame([(None, f"text {i}", "a", "en", None) for i in range(400)] + [(None, "again", "a", "en", None)] * 3, SCHEMA)
    got = sample(own, keep=0.5)
    assert 120 < got.filter("text != 'again'").count() < 280 and got.filter("text = 'again'").count() in (0, 3)


def residual(cells, w, targets):
    n = np.array([c[3] for c in cells], float)
    share, worst = n * w / n.sum(), 0.0
    for d, t in enumerate(targets):
        for v in t:
            worst = max(worst, abs(sum(x for x, c in zip(share, cells, strict=True) if c[d] == v) / t[v] - 1) if t[v] else 0.0)
    return worst


def temperature(cells):
    out = []
    for d, name in enumerate(("source", "lang", "topic")):
        n = Counter()
        for c in cells:
            n[c[d]] += c[3]
        t = {k: v ** TEMPERATURE[name] for k, v in n.items()}
        out.append({k: v / sum(t.values()) for k, v in t.items()})
    return out


def test_raking_goes_on_until_it_converges():
    """Marginals that need hundreds of sweeps hold in the end; those that can't hold stop, and the residual says so."""
    cells = [("a", "x", "p", 1_000_000), ("a", "y", "p", 1), ("b", "x", "p", 1), ("b", "y", "p", 1_000_000)]
    targets = {"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}, "topic": {"p": 1}}
    w, off = rake(cells, targets)
    assert off < 1e-9 and residual(cells, w, [{"a": 0.5, "b": 0.5}, {"x": 0.75, "y": 0.25}, {"p": 1}]) < 1e-8
    stuck = [("a", "x", "p", 10), ("b", "y", "p", 10)]
    w, off = rake(stuck, targets)
    assert off > 0.1 and abs(residual(stuck, w, [{"a": 0.5, "b": 0.5}, {"x": 0.75, "y": 0.25}, {"p": 1}]) - off) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.sampled_from("pq"), st.integers(1, 1000)), min_size=1, max_size=12, unique_by=lambda c: c[:3]))
def test_residual_is_that_of_the_marginals(cells):
    w, off = rake(cells)
    assert abs(residual(cells, w, temperature(cells)) - off) < 1e-6 * max(1, off)


def test_topics_separate_vocabularies(spark):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice([f"v{i % 3}w{k}" for k in range(60)], 80)),) for i in range(900)]
    m = topics.fit(spark.createDataFrame(rows, "text string"))
    got = m.assign([s for _, s in topics.bucket_sets(t for t, in rows)])
    for k in set(got):
        assert len({i % 3 for i in np.flatnonzero(got == k)}) == 1
    again = topics.fit(spark.createDataFrame(rows[::-1], "text string").repartition(3))
    assert (again.scores == m.scores).all()
    assert topics.fit(spark.createDataFrame([], "text string")).assign([np.zeros(0, np.int64), np.array([3])]).tolist() == [-1, 0]


def test_words_and_topics_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [None, "", " \n", "one", *[" ".join(rng.choice(["a", "B\tc", "é", "日本"], k)) for k in (1, 5, 60)], "long " * 300_000]
    whole = [(n, s.tolist()) for n, s in topics.bucket_sets(texts)]
    assert [n for n, _ in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    monkeypatch.setattr(topics, "BLOCK_BYTES", 10)
    assert [(n, s.tolist()) for n, s in topics.bucket_sets(texts)] == whole


def test_query_equals_brute_force(spark):
    """Weights, probabilities and draws of all rows, from topics that a plain loop assigns."""
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    m = topics.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    got = {r.doc_id: r for r in op6_mixing_ipf(spark, "/root/testdata/sf0.001").collect()}
    cells, own = Counter(), {}
    for i, r in docs.items():
        (n, buckets), = topics.bucket_sets([r.text])
        fit = [sum(int(m.scores[k, b]) for b in buckets) for k in range(topics.TOPICS)]
        own[i] = (r.source, r.lang, f"t{fit.index(max(fit))}" if n else "none")
        cells[own[i]] += n
        assert (got[i].source, got[i].lang, got[i].topic, got[i].n_tokens) == (*own[i], len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    keys = sorted(cells)
    goal, w, total = temperature([(*k, cells[k]) for k in keys]), {k: float(cells[k]) for k in keys}, sum(cells.values())
    for _ in range(2000):
        for d in range(3):
            s = Counter()
            for k in keys:
                s[k[d]] += w[k]
            w = {k: w[k] * goal[d][k[d]] / s[k[d]] if s[k[d]] else w[k] for k in keys}
    weight = {k: w[k] * total / cells[k] if cells[k] else 1.0 for k in keys}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(cells[k] * min(1, mid * weight[k]) for k in keys) < KEEP * total else (lo, mid)
    for i, r in got.items():
        p = min(1.0, hi * weight[own[i]])
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert abs(r.weight - weight[own[i]]) < 2e-6 * max(1, weight[own[i]]) and abs(r.probability - p) < 2e-6 and (r.selected == (u < p) or abs(u - p) < 1e-5)
