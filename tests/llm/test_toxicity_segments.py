import random
import sys

from vellumine.llm import toxicity_segments as t


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best (leftmost, then shortest) segment, then recur left and right of it."""

    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-9 and (top is None or total > top[2] + 1e-9):
                    top = (i, j, total)
        return top

    def run(lo, hi):
        top = best(lo, hi)
        return [] if top is None else run(lo, top[0]) + [top] + run(top[1] + 1, hi)

    return run(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        other = -rng.uniform(0.1, 1.2)
        n = rng.randrange(1, 25)
        hits = sorted((i, rng.uniform(0.3, 3)) for i in range(n) if rng.random() < 0.35)
        scores = [dict(hits).get(i, other) for i in range(n)]
        got = t.segments(hits, other)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def lines_run(hits, other):
    n = 0

    def trace(frame, event, _):
        nonlocal n
        n += event == "line"
        return trace if frame.f_code is t.segments.__code__ else None

    sys.settrace(trace)
    try:
        t.segments(hits, other)
    finally:
        sys.settrace(None)
    return n


def test_scan_is_linear():
    """Steps, not seconds: isolated hits (each final at once), and hits that merge late."""
    for n in (10_000, 100_000):
        assert lines_run([(1000 * i, 1.0) for i in range(n)], -0.1) < 25 * n
        rng = random.Random(n)
        assert lines_run([(int(i * 1.3), rng.uniform(0.01, 0.2)) for i in range(n)], -0.4) < 30 * n


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "straße", "été", "of", "the"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(30, 90))
        y = i % 4 == 0
        if y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "Foul"]))
        docs.append((i, " ".join(w), "k"))
        labels.append((i, int(y)))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    m = t.fit(d, t.fit_labels(spark.createDataFrame(labels, "doc_id long, toxic int")))
    return m, {r.doc_id: r for r in t.score(d, m).collect()}


def test_learns_and_marks_passages(spark):
    docs, labels = corpus(400, 3)
    docs += [(1000, None, "k"), (1001, "", "k"), (1002, "so VILE and foul, vile " + "beta " * 40, "k"), (None, "vile", "k")]
    m, got = run(spark, docs, [*labels, (None, 1), (5, None), (4, 1), (9999, 1)])
    assert set(m.scores) == {"vile", "foul"}
    held = [i for i, _, _ in docs if i is not None and i < 400]
    assert all((got[i]._toxicity.score >= 0.3) == (i % 4 == 0) for i in held)
    (p,) = got[1002]._toxicity.passages
    assert docs[402][1][p.start : p.end] == "VILE and foul, vile"
    assert got[1000]._toxicity.score == got[1001]._toxicity.score < 0.05


def test_copies_do_not_make_words_toxic(spark):
    docs, labels = corpus(400, 4)
    docs += [(2000 + 4 * i, "unusual phrases copied verbatim vile foul", "k") for i in range(200)]
    m, _ = run(spark, docs, labels + [(2000 + 4 * i, 1) for i in range(200)])
    assert set(m.scores) == {"vile", "foul"}


def test_no_labels_and_no_rows(spark):
    m, got = run(spark, [(1, "x", "k")], [])
    assert got[1]._toxicity.score == 0
    assert run(spark, [], [])[1] == {}
    m, got = run(spark, [(1, "x", "k")], [(1, 1)])
    assert not m.scores
