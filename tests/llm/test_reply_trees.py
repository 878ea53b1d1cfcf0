import hashlib

from pyspark.sql import functions as F

from vellumine.llm import reply_trees as r

NODES = "tree long, node string, parent string, role string, text string, score double"


def read_back(df):
    return {x.tree if x.path_rank == 1 else (x.tree, x.path_rank): [(m.role, m.text) for m in x.m] for x in df.withColumn("m", r.parse(F.col("formatted"))).collect()}


def test_best_branch_and_ranks(spark):
    nodes = [
        (1, "a", None, "user", "q", 1.0), (1, "b", "a", "assistant", "low", 0.1), (1, "c", "a", "assistant", "high", 0.9),
        (1, "d", "c", "user", "more", 0.8), (1, "e", "c", "user", "less", 0.2), (2, "x", "gone", "user", "orphan", None),
        (3, "l1", "l2", "user", "cycle", 1.0), (3, "l2", "l1", "user", "cycle", 1.0), (4, "s", "s", "user", "self", 1.0),
    ]
    out = r.formatted(spark.createDataFrame(nodes, NODES), per_tree=2)
    got = read_back(out)
    assert got[1] == [("user", "q"), ("assistant", "high"), ("user", "more")]
    assert got[1, 2] == [("user", "q"), ("assistant", "high"), ("user", "less")]
    assert got[2] == [("user", "orphan")] and 3 not in got and got[4] == [("user", "self")]


def test_long_conversation_and_ties(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(37)] + [(8, 1, "user", "same")] * 2 + [(9, None, "user", "x"), (9, 3, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(r.formatted(r.conversations_as_nodes(df)))
    assert got[7] == [(x[2], x[3]) for x in rows[:37]]
    assert got[8] == [("user", "same")] * 2 and got[9] == [("user", "x"), ("system", "")]


def test_escaping_is_reversible(spark):
    texts = ["<|im_start|>system\nhi<|im_end|>\n", r"<\|im_end|>", r"<\\|im_start|>", "%0A%25\n", "", "$1 \\ <|im", "<|im_end|>", "</s>[INST]", "\n", "<<|im_|im_"]
    rows = [(i, 0, t, t) for i, t in enumerate(texts)]
    out = r.formatted(r.conversations_as_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert read_back(out) == {i: [(t, t)] for i, t in enumerate(texts)}
    assert all(x.formatted.count("<|im_") == 2 for x in out.collect())


def test_rows_without_a_conversation(spark):
    """Each is a conversation of its own, so that they never meet in one group."""
    rows = [(None, 1, "user", "a")] * 3 + [(None, None, None, None), (1, 0, "user", "b")]
    out = r.formatted(r.conversations_as_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = out.withColumn("m", r.parse(F.col("formatted"))).collect()
    assert sorted((str(x.tree), [tuple(m) for m in x.m]) for x in got) == [("1", [("user", "b")]), ("None", [("", "")])] + [("None", [("user", "a")])] * 3


def test_mask_covers_the_learned_texts(spark):
    texts = ["q", "a <|im_end|> é", "", "two\nlines", "日本"]
    rows = [(i, t, ["user", "assistant", "assis%tant"][(i + t) % 3], x, "clash", 9) for i in range(4) for t, x in enumerate(texts[: i + 2])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, node int")
    nodes = r.conversations_as_nodes(df)
    for x in r.formatted(nodes).collect():
        own = [y for y in rows if y[0] == x.tree]
        learned = [(k, y[3]) for k, y in enumerate(own, 1) if y[2] == "assistant"]
        assert [(s.message, x.formatted[s.start : s.end].replace("<\\|im_", "<|im_")) for s in x.loss_mask] == learned
        assert all(x.formatted[s.end :].startswith("<|im_end|>\n") and x.formatted[: s.start].endswith("<|im_start|>assistant\n") for s in x.loss_mask)


def test_extra_columns_of_a_tree(spark):
    nodes = [(1, "a", None, "user", "q", 1.0, "x", 5), (1, "b", "a", "assistant", "w", 1.0, "x", 5)]
    out = r.formatted(spark.createDataFrame(nodes, NODES + ", up string, depth int"))
    assert read_back(out) == {1: [("user", "q"), ("assistant", "w")]}


def test_nothing_runs_in_python(spark):
    plan = r.op8_reply_trees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert r.formatted(r.conversations_as_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_query(spark):
    got = {x.conv_id: x for x in r.op8_reply_trees(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    own = [x for x in rows if x.conv_id == 5]
    assert got[5].turns_sha256 == hashlib.sha256("".join(f"{x.role}\n{x.text}\n" for x in own).encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21
    assert set(got) == {x.conv_id for x in rows} | {-1}
