import random
import re

import numpy as np
import xxhash

from vellumine.llm import simhash_golay as g

SCHEMA = "doc_id long, text string, fp string, `key` int"


def brute_print(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in g.classes(df).collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "a", "straße", "ÉA", "thation" * 5, "x|y", "日本", "of"]
    return [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 9, 60]))) for _ in range(n)]


def test_hashes_equal_the_library(spark):
    t = [None, "", " \n", "A", "a b", "x" * 500, "q " * 5000, *texts(60, 1)]
    assert g.fingerprints(iter(t)).tolist() == [brute_print(x) for x in t]
    assert g.fingerprints(iter(t), 5).tolist() == [brute_print(x, 5) for x in t]


def test_a_long_text_is_hashed_in_blocks(monkeypatch):
    t = texts(30, 5)
    whole = g.fingerprints(iter(t)).tolist()
    monkeypatch.setattr(g, "BLOCK_SHINGLES", 7)
    monkeypatch.setattr(g, "BLOCK_BYTES", 50)
    assert g.fingerprints(iter(t)).tolist() == whole


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    assert all(set(x) & set(y) for x, y in zip(map(np.ndarray.tolist, g.golay_keys(a)), map(np.ndarray.tolist, g.golay_keys(b)), strict=True))


def test_components_equal_brute_force(spark):
    base = texts(40, 2)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + " and") for i, t in enumerate(base) if len(t) > 150]
    rows += [(i, t) for i, t in rows[:7]] + [(None, base[0]), (None, None), (500, ""), (None, "only here")]
    assert run(spark, rows) == brute_classes(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_large_buckets_lose_no_link(spark, monkeypatch, tmp_path):
    """All prints share their first segment: with a bucket of 3, most take the other way."""
    rng = random.Random(7)
    prints = {rng.getrandbits(7) << 50 | 5 for _ in range(60)} | {(1 << 63) | 5, (3 << 62) | 5}
    prints = [x - (1 << 64) * (x >> 63) for x in prints]
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")

    def roots(edges):
        return {(r.node, r.root) for r in g.components(edges, str(tmp_path / f"{rng.random()}")).collect()}

    assert {tuple(r) for r in g.links(df, str(tmp_path / "a")).collect()} >= set()
    monkeypatch.setattr(g, "BUCKET", 3)
    few = g.links(df, str(tmp_path / "b"))
    assert {tuple(r) for r in few.collect()} <= want
    assert roots(few) == roots(spark.createDataFrame(sorted(want), "a long, b long"))
