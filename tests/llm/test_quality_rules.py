import random
import re
from collections import Counter

import pytest

from vellumine.llm import quality_rules as q

SCHEMA = "doc_id long, text string, measures int, fail_bits string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The measurements, straight from their definitions."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(repeated),
        "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)),
    }


def brute_bits(m):
    fails = [
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > 3 * m["n_words"],
        2 * m["n_dup_lines"] > m["n_lines"], 10 * m["n_upper"] > 6 * (m["n_upper"] + m["n_lower"]), m["word_chars"] > 40 * m["n_words"],
    ]
    return sum(1 << i for i, x in enumerate(fails) if x)


def texts():
    rng = random.Random(3)
    bits = ["a", "B", "the cat", "#", "|", "é", "日本", "SHOUT", "\n", "\t", "  ", "same line\n", "x" * 60, "\x0b", "\x85", " ", "퟿"]
    out = [None, "", " \n\t", "one", "same\nsame\nsame", "a b c a b c", "a b a b a b a", "LOUD " * 60, "# " * 80]
    return out + [rng.choice([" ", "", "\n"]).join(rng.choices(bits, k=rng.choice([3, 30, 120]))) for _ in range(150)]


def test_measures_equal_brute_force():
    for t in texts():
        assert dict(zip(q.MEASURES, q.measure(t), strict=True)) == brute(t), t


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i, x, i, "x") for i, x in enumerate(t)] + [(None, t[20], None, None), (7, t[7], 7, "x"), (7, t[7], 7, "x")]


def test_ledger_and_clashing_columns(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in q.ledger(df).collect()), key=repr)
    want = sorted(((d, *brute(t).values(), brute_bits(brute(t))) for d, t, *_ in rows), key=repr)
    assert got == want
    assert q.ledger(df.limit(0)).collect() == []


@pytest.mark.parametrize("policy", q.POLICIES)
def test_policies_keep_what_brute_force_keeps(spark, rows, policy):
    df = spark.createDataFrame(rows, SCHEMA)
    out = q.apply_policy(df, policy)
    bad = sum(1 << list(q.RULES).index(r) for r in q.POLICIES[policy])
    assert out.columns == df.columns
    assert Counter(map(repr, out.collect())) == Counter(repr(r) for r in df.collect() if not brute_bits(brute(r.text)) & bad)


@pytest.mark.parametrize("policy", q.POLICIES)
def test_ablation_equals_brute_force(spark, rows, policy):
    book = q.ledger(spark.createDataFrame(rows, SCHEMA))
    got = {r["rule"]: (r["n_docs"], r["n_failing"], r["n_only"], r["n_kept_without"]) for r in q.ablation(book, policy).collect()}
    names, own = list(q.RULES), q.POLICIES[policy]
    each = [{names[k] for k in range(len(names)) if brute_bits(brute(t)) >> k & 1} & set(own) for _, t, *_ in rows]
    assert got == {r: (len(each), sum(r in x for x in each), sum(x == {r} for x in each), sum(not x - {r} for x in each)) for r in own}
    assert q.ablation(book.limit(0), policy).collect() == []


def test_very_long_text():
    t = "word " * 600_000 + "\n" + "x" * 1_000_000
    m = dict(zip(q.MEASURES, q.measure(t), strict=True))
    assert (m["n_words"], m["n_repeat_words"], m["word_chars"]) == (600_001, 600_000, 3_400_000)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = q.op9_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        m = brute(docs[r.doc_id])
        bits = brute_bits(m)
        fails = [n for k, n in enumerate(q.RULES) if bits >> k & 1 and n in q.POLICIES["v2"]]
        assert {k: r[k] for k in q.MEASURES[:5]} == {k: m[k] for k in q.MEASURES[:5]}
        assert (r.base_failed, r.kept, r.fail_bits, r.sole_rule) == (bool(bits & 3), not fails, bits, fails[0] if len(fails) == 1 else None)
