"""Evaluation of answers and rankings: the filter of scored questions, offline metrics and their means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions import patterns as P
from vellumine.functions import text as X


def scored(rows: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Questions that have an answer: the truth is neither empty nor the mark of unanswerable ones."""
    value = F.btrim(X.text(truth), F.lit(" \t\n\r"))
    return rows.filter((value != "") & ~F.startswith(value, F.lit(P.UNANSWERABLE)))


def dataset(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """(query_id, question, answer, contexts, ground_truth) of the scored questions; both context lists in order."""
    rows = scored(answers.join(truths, "query_id"))
    return rows.select("query_id", F.col("text").alias("question"), "answer", F.concat("dq_context_list", "gq_context_list").alias("contexts"), "ground_truth")


def token_recall(a: Column, b: Column) -> Column:
    """The share of b's distinct words that a has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(X.text(c)), r"(?U)\W+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(a), words(b))) / F.nullif(F.size(words(b)), F.lit(0)), F.lit(0.0))


#: The four judged scores by name, as column functions (question, answer, contexts, truth); a model may replace each.
JUDGES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "faithfulness": lambda q, a, c, t: token_recall(F.array_join(c, "\n"), a),
    "answer_relevancy": lambda q, a, c, t: token_recall(a, q),
    "context_precision": lambda q, a, c, t: F.coalesce(F.size(F.filter(c, lambda x: token_recall(x, t) >= 0.5)) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0)),
    "context_recall": lambda q, a, c, t: token_recall(F.array_join(c, "\n"), t),
}


def judged(rows: DataFrame, judges: dict[str, Callable] = JUDGES) -> DataFrame:
    return rows.select("*", *[f(F.col("question"), F.col("answer"), F.col("contexts"), F.col("ground_truth")).cast("double").alias(n) for n, f in judges.items()])


def means(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: the mean of each score."""
    return rows.agg(*[F.avg(n).alias(n) for n in names or list(JUDGES)])


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, n_hits, recall, reciprocal_rank) at ``k``; ranked has (query_id, item, rank), relevant (query_id, item)."""
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return _metrics(total, ranked.filter(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "item"]))


def label_metrics(ranked: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``ranking_metrics`` where all ``items`` (item, label; an item has one) of the label of a question (query_id, label) are
    relevant: counted by label, so that no pair of a question and an item is made but the ranked ones."""
    asked, items = asked.filter("label IS NOT NULL").distinct(), items.filter("label IS NOT NULL").distinct()
    sizes = items.groupBy("label").agg(F.count("*").alias("n"))
    total = asked.join(sizes, "label").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    return _metrics(total, ranked.filter(F.col("rank") <= k).join(items, "item").join(asked, ["query_id", "label"]))


def _metrics(total: DataFrame, found: DataFrame) -> DataFrame:
    """Of the relevant items' numbers and those found (query_id, item, rank)."""
    hits = found.groupBy("query_id").agg(F.countDistinct("item").alias("n_hits"), F.min("rank").alias("first"))
    out = total.join(hits, "query_id", "left")
    n = F.coalesce("n_hits", F.lit(0)).cast("long")
    return out.select("query_id", "n_relevant", n.alias("n_hits"), (n / F.col("n_relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
