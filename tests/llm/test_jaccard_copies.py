import random

from pyspark.sql import functions as F

import corpus_pipeline
from vellumine.llm import jaccard_copies as j
from vellumine.llm.simhash_golay import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.random()}"
    return " ".join(out)


def texts():
    rng = random.Random(4)
    rows = [None, "", "one", "one two", "ONE  two"]
    for k in range(12):
        words = [f"w{k}x{rng.randrange(400)}" for _ in range(150)]
        rows += [" ".join(words), *[edited(rng, words, n) for n in (1, 2, 3, 4, 9)]]
    hot = [f"h{i}" for i in range(150)]
    return rows + [edited(rng, hot, rng.randint(1, 3)) for _ in range(60)]


def least(rows):
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and similar(rows[a], rows[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return sorted(set(root))


def test_the_stage_drops_what_brute_force_drops(spark, tmp_path):
    rows = texts()
    want = least(rows)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], SCHEMA)
    got = corpus_pipeline.near_copies(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == want


def test_large_groups_whose_copies_differ(spark, tmp_path):
    """Short copies with one to three edits (most pairs under 0.8), copies of these copies, and texts that share half their words."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [edited(rng, base, rng.choice([1, 1, 2, 2, 3])) for _ in range(120)]
    rows += [edited(rng, rows[i].split(), 1) for i in range(0, 120, 3)]
    rows += [" ".join(base[:40] + [f"o{k}x{i}" for i in range(rng.choice([12, 30]))]) for k in range(60)]
    rows += [edited(rng, rows[160 + i].split(), 1) for i in range(0, 60, 4)]
    want = least(rows)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, str(tmp_path)).collect()) == want


def test_the_sets_of_a_large_group_meet_one_centre(spark, monkeypatch):
    """Their differences are spread out once and not once for each centre of their buckets."""
    rng = random.Random(3)
    base = [f"g{i}" for i in range(120)]
    rows = [" ".join(base), *[edited(rng, base, rng.randint(1, 5)) for _ in range(400)]]
    tables, write = {}, j.written

    def kept(df, folder, name):
        tables[name] = write(df, folder, name)
        return tables[name]

    monkeypatch.setattr(j, "written", kept)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA)
    got = sorted(r.doc_id for r in j.representatives(df).collect())
    assert tables["around"].count() <= 1.2 * tables["around"].select("s").distinct().count()
    assert got == least(rows)


def test_fingerprints_link_what_is_within_two_bits(spark, tmp_path):
    """Golay keys alone, without any MinHash key."""
    j.prepare(spark)
    rng = random.Random(12)
    rows = [None, "one two"]
    for k in range(30):
        words = [f"p{k}x{i}" for i in range(500)]
        rows += [" ".join(words), edited(rng, words, 1), edited(rng, words, 2)]
    sets = j.shingle_sets(rows)
    prints = [int(x) for x in j.fingerprints(sets)]
    assert prints == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2 and similar(rows[a], rows[b])}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "own long, text string").select("own", j.sets_udf("text").alias("x"))
    df = df.select("own", "x.s", "x.n", "x.fp", "x.shingles").localCheckpoint()
    bare = df.select("s", "n", "fp", "own", F.array().cast("array<bigint>").alias("keys"))
    links = j.links(bare, lambda owns: df.join(owns, "own").select("s", "n", "shingles"), str(tmp_path / "l"))
    root = {r.node: r.root for r in components(links, str(tmp_path / "c")).collect()}
    name = {r.own: root.get(r.s, r.s) for r in df.collect()}
    assert len(want) > 10 and all(name[a] == name[b] for a, b in want)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(7, "one two three four five six", "k"), (7, "one two three four five six", "k"), (None, "other words here", None), (None, "other words here", None), (8, "ONE two three four five six", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = sorted(map(tuple, j.representatives(df).collect()), key=repr)
    assert got == sorted([rows[0], rows[2]], key=repr)


def test_empty(spark):
    assert j.representatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sets_do_not_depend_on_blocks(monkeypatch):
    rows = texts()
    whole = [s.tolist() for s in j.shingle_sets(rows)]
    assert [len(s) for s in whole] == [len(shingles(t)) if (t or "").split() else 0 for t in rows]
    monkeypatch.setattr(j, "BLOCK_BYTES", 50)
    assert [s.tolist() for s in j.shingle_sets(rows)] == whole
