"""Chat formatting of reply trees, with DataFrame operations only.

A table of messages (tree, node, parent, role, text, score) holds reply trees. Iterative self-joins double pointers:
after round k a node knows its 2 ** k-th ancestor, its depth and the sum of scores up to there, so a path of n
messages takes log2(n) rounds and rows never grow with the square of a path. Leaves are ranked per tree by the mean
score of their root-to-leaf path (ties: the longer path, then the smaller leaf), and the chosen leaves' paths are
enumerated by the same pointers from the largest step down: a leaf's row becomes rows for all its ancestors, each
once. Texts are joined to the chosen (path, node) rows last, and each path is formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside texts and roles every ``<|im_`` (with any number
of backslashes after ``<``) gets one more backslash after ``<``, so markers in the output are only the template's;
``parse`` takes that backslash away again. A role's ``%`` and line feeds become ``%25`` and ``%0A``.
The loss mask is stored beside each conversation: for every text of the assistant its message's number and the code points
(start, end) of the escaped text in the formatted one.

A formatted conversation is one value, so a single conversation must fit into a row (2 GB); no other group is
gathered into one task. A message with very many replies is a hot key of the pointer joins; adaptive skew joins split
the side that repeats it, the other has one row a message.

Defined cases: null texts and roles count as empty; a message whose parent is missing, or is itself, starts a tree
path of its own; messages on a parent cycle belong to no root-to-leaf path; repeated rows are messages of their own,
in the given turn order (ties: role, then text); every row with a null conversation id is a conversation of its own, and
every root-to-leaf path of a null tree ranks first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import column, prepare, shared_dir, table, written

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|im_", r"<$1\\|im_")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_", r"<$1|im_")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END))


def parse(formatted: Column) -> Column:
    """The messages of a formatted conversation, read back: an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def pointers(nodes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The pointer tables of each round, (node, up: its 2 ** k-th ancestor), and (node, depth, total) with depth
    the number of messages from the root and total their scores' sum; only nodes that reach a root."""
    ids = nodes.select(F.col("node").alias("id"))
    now = (
        nodes.join(ids, nodes.parent == ids.id, "left")
        .select("node", F.when(F.col("id") != F.col("node"), F.col("id")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    )
    tables, done, k, most = [], None, 0, nodes.count()
    while True:
        now = written(now, folder, f"up-{k}")
        ended, going = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
        done = ended if done is None else done.union(ended)
        if going.isEmpty() or (1 << k) > most:  # what still has an ancestor after that many steps is on a cycle
            return tables, done.select("node", "depth", "total")
        tables.append(going.select("node", "up"))
        above = done.union(going).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        # only nodes below their root take part in the next round
        now = going.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"))
        k += 1


def paths(nodes: DataFrame, folder: str, per_tree: int = 1) -> DataFrame:
    """The messages of each tree's ``per_tree`` best root-to-leaf paths: (tree, leaf, node, depth, path_rank).

    ``nodes``: tree, node (distinct), parent (null: a root), score (double).
    """
    tables, reached = pointers(nodes, folder)
    replied = nodes.filter("parent != node").select(F.col("parent").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(replied, "node", "left_anti")
    rank = Window.partitionBy("tree", F.when(F.col("tree").isNull(), F.col("node"))).orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    best = leaves.join(reached, "node").withColumn("path_rank", F.row_number().over(rank)).filter(F.col("path_rank") <= per_tree)
    path = best.select("tree", F.col("node").alias("leaf"), "node", "path_rank")
    for k in reversed(range(len(tables))):
        up = path.join(tables[k], "node").select("tree", "leaf", F.col("up").alias("node"), "path_rank")
        path = written(path.union(up), folder, f"path-{k}")
    return path.join(reached.select("node", "depth"), "node")


def conversations_as_nodes(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: each message replies to the one before it. Columns: tree, node, parent, role, text, score."""
    rows = rows.select(column(rows, conv_id).alias("tree"), column(rows, turn).alias("turn"), column(rows, role).alias("role"), column(rows, text).alias("text"))
    # one conversation must fit into a row of the output, which bounds this window's group
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    node = lambda n: F.concat(F.col("tree").cast("string"), F.lit(":"), n.cast("string"))
    named = rows.filter("tree IS NOT NULL").withColumn("place", place).select(
        "tree", node(F.col("place")).alias("node"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"),
        "role", "text", F.lit(1.0).alias("score"),
    )
    alone = rows.filter("tree IS NULL").select(
        "tree", F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )
    return named.union(alone)


def formatted(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """One row per chosen path: tree, path_rank, leaf, formatted, loss_mask (message, start, end).

    ``nodes``: tree, node, parent, role, text, score.
    """
    spark = nodes.sparkSession
    prepare(spark)
    folder = shared_dir(spark)
    nodes = written(nodes, folder, "nodes")
    chosen = paths(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), folder, per_tree)
    head = F.lit(len(START) + 1) + F.length(escape_role(F.col("role")))
    own = nodes.select("node", message(F.col("role"), F.col("text")).alias("message"), head.alias("head"), F.coalesce(F.col("role") == LEARNED, F.lit(False)).alias("learned"))
    path = Window.partitionBy("tree", "path_rank", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("message")).over(path), F.lit(0))
    said = chosen.join(own, "node").withColumn("start", at + F.col("head")).withColumn("end", at + F.length("message") - len(END))
    turns = F.array_sort(F.collect_list(F.struct("depth", "message", "start", "end", "learned")))
    out = said.groupBy("tree", "path_rank", "leaf").agg(turns.alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.depth.alias("message"), t.start.alias("start"), t.end.alias("end")))
    return out.select("tree", "path_rank", "leaf", F.array_join(F.transform("turns", lambda t: t.message), "").alias("formatted"), mask.alias("loss_mask"))


def op8_reply_trees(spark, sf_dir: str) -> DataFrame:
    """All ``conversations``, and conversation -1, formatted; the returned columns are read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    out = formatted(conversations_as_nodes(rows.union(extra))).withColumn("m", parse(F.col("formatted")))
    learned = F.array_join(F.transform("loss_mask", lambda x: F.element_at("m", x.message.cast("int")).text), "")
    said = F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("m").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
e AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|im_', '<\1\\|im_', 'g') || chr(10)
    || regexp_replace(text, '<(\\*)\|im_', '<\1\\|im_', 'g') || '<|im_end|>' || chr(10) AS message FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(message)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
