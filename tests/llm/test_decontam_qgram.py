import random

import numpy as np

from vellumine.llm import decontam_qgram as g

ALPHABET = "abcdefghij "


def plain(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def least_edits(item, text):
    """Least edits of the whole item against any region of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        k = rng.randrange(3)
        if k == 0:
            t[i] = rng.choice(ALPHABET)
        elif k == 1:
            t.insert(i, rng.choice(ALPHABET))
        else:
            del t[i]
    return "".join(t)


def words(n, rng):
    return " ".join("".join(rng.choices(ALPHABET[:10], k=rng.randrange(1, 9))) for _ in range(n))


def test_matches_equal_brute_force():
    rng = random.Random(4)
    items = [(i, words(rng.choice([3, 8, 15, 30]), rng)) for i in range(12)]
    texts = []
    for _ in range(120):
        _, t = rng.choice(items)
        n = int(len(t) * rng.choice([0, 0.04, 0.07, 0.09, 0.12]))
        texts.append(words(rng.randrange(0, 40), rng) + " " + edited(t, n, rng) + " " + words(rng.randrange(0, 40), rng))
    assert_equal(items, texts)


def assert_equal(items, texts):
    got = g.find_all(texts, g.Index(items))
    for t, found in zip(texts, got, strict=True):
        want = {}
        for i, x in items:
            m = len(plain(x))
            d = least_edits(plain(x), plain(t)) if m >= 1 / g.RATE else 0 if m and f" {plain(x)} " in f" {plain(t)} " else 99
            if d <= int(m * g.RATE):
                want[i] = d
        assert {m[0]: m[1] for m in found} == want, (t, want, found)


def test_items_of_every_length():
    """From one character on, with the stated budget and none less; several texts a block, so fences are between them."""
    rng = random.Random(7)
    items = [(m, plain(("".join(rng.choices(ALPHABET, k=m - 1)) + "ab")[:m].strip().rjust(m, "c"))) for m in range(1, 60)]
    texts = ["a b c d", "", "c", "xx"]
    for m, x in items:
        for n in (0, int(m * g.RATE), int(m * g.RATE) + 1):
            texts.append(words(rng.randrange(3), rng) + " " + edited(x, n, rng) + " " + words(rng.randrange(3), rng))
    assert_equal([*items, (100, "a b c d"), (101, "日本 語")], [*texts, "これは 日本 語 です", "日本語"])
    assert [m[0] for m in g.find_all(["a b c d"], g.Index([(5, "A, b. C-d")]))[0]] == [5]


def test_no_region_spans_two_texts():
    rng = random.Random(11)
    item = words(30, rng)
    for cut in range(10, len(item) - 10, 9):
        found = g.Index([(1, item)]).find(["so " + item[:cut].strip(), item[cut:].strip() + " and", item[:cut].strip()])
        budget = int(len(plain(item)) * g.RATE)
        assert [[m[1] for m in x] for x in found] == [[d] if (d := least_edits(plain(item), plain(t))) <= budget else [] for t in ("so " + item[:cut], item[cut:] + " and", item[:cut])]


def test_index_is_built_once_a_block(spark, monkeypatch, tmp_path):
    """Five blocks: each worker builds each index once, however many batches it sees."""
    rng = random.Random(13)
    items = [(i, words(20, rng)) for i in range(10)]
    monkeypatch.setattr(g, "BLOCK_CHARS", sum(len(t) for _, t in items) // 5 + 1)
    docs = spark.createDataFrame([(i, words(10, rng) + " " + items[i % 10][1], 0) for i in range(200)], SCHEMA)
    out, name = g.with_matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, tuple(m.item_id for m in r[name])) for r in out.collect()} == {(i, (i % 10,)) for i in range(200)}
    built = []
    monkeypatch.setattr(g, "Index", lambda x: built.append(x))
    for _ in range(3):
        g._index("block", type("B", (), {"value": items}))
    assert len(built) == 1


def test_spans_case_and_marks():
    rng = random.Random(6)
    item = words(30, rng)
    text = "Ünïcode 日本 " + words(5, rng) + "!! [" + item.upper().replace(" ", ",  ") + "] " + words(5, rng)
    ((i, edits, a, b),) = g.find_all([text], g.Index([(9, item)]))[0]
    assert (i, edits) == (9, 0) and text[a:b] == item.upper().replace(" ", ",  ")


def test_hashes_are_of_q_characters():
    codes = np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 7], np.uint32)
    for q in (1, 2, 3, 5, 7, 8):
        h = g._hashes(codes, q)
        assert len(h) == len(codes) - q + 1
        assert [(h[i] == h[0]) for i in range(len(h))] == [codes[i : i + q].tolist() == codes[:q].tolist() for i in range(len(h))]


SCHEMA = "doc_id long, text string, matches int"


def test_frames_blocks_and_edge_cases(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(20, rng)) for i in range(6)] + [(None, words(20, rng)), (50, None), (51, ""), (52, "tiny"), (0, words(20, rng))]
    items.append(items[1])
    docs = [(i, words(30, rng) + " " + t + " " + words(3000 if i == 2 else 3, rng), 1) for i, t in items[:6]]
    docs += [(None, items[2][1], 1), (60, None, 1), (61, "", 1), (62, words(50, rng), 1), (63, items[10][1] + " . " + items[3][1], 1), docs[0]]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, [i]) for i in range(6)] + [(None, [2]), (60, []), (61, []), (62, []), (63, [0, 3]), (0, [0])], key=repr)
    for chars in (g.BLOCK_CHARS, 200):
        monkeypatch.setattr(g, "BLOCK_CHARS", chars)
        out, name = g.with_matches(d, b)
        assert name == "_matches"
        assert sorted(((r.doc_id, [m.item_id for m in r._matches]) for r in out.collect()), key=repr) == want
    kept = g.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [60, 61, 62]
    assert g.clean(d, b.limit(0)).count() == len(docs) and g.clean(d.limit(0), b).collect() == []
