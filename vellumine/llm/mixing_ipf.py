"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking scales the cells' weights so that their sums meet the
target marginals of one dimension after the other, until all three hold (``CLOSE``) or no longer come closer. A cell's weight is its
raked share over its share of the corpus. A document is sampled with probability min(1, f * weight): f is chosen so that the
expected tokens are ``KEEP`` of all, and where the product exceeds 1 the whole cell stays. The draw is a hash of the
document's id, so it is the same whenever and wherever it is made.

Targets are given per dimension as value -> weight, or by temperature: the corpus's shares to the power of
``TEMPERATURE``, which lowers the large and raises the small. Values without a target get weight zero.

The topic, unless a column names it, is learned from the corpus's words (``topics``).

Up to ``MAX_CELLS`` cells are raked on the driver and broadcast; more are raked as a table, each sweep written to the
shared folder, and joined. ``cell_weights`` says in ``residual`` how far, relatively, the worst marginal is from its target.

Defined cases: null and empty texts have no tokens (topic ``none``) and a cell without tokens has weight 1; null sources,
languages and topics are values of their own; null ids draw by the hash of the text; repeated rows share their draw;
marginals that can't all hold (a value of one dimension occurs only with values that have no target) are approached until
a sweep no longer helps, and the residual tells; an empty table gives an empty result; ``sample`` keeps all columns and
names of new ones never clash.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm import topics
from vellumine.llm.common import column, fresh, prepare, shared_dir, table, written

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.9}
KEEP = 0.9
CLOSE = 1e-10
PATIENCE = 20  # sweeps within which the worst marginal must come closer by a hundredth
MAX_CELLS = 100_000
NULL = "\x00null"

Targets = Mapping[str, Mapping[str | None, float]]


def measured(m: topics.Topics):
    """A column function: a text's words (runs of characters other than space and \\t\\n\\v\\f\\r) and its topic."""

    def run(texts: pa.Array) -> pa.Array:
        found = list(topics.bucket_sets(t.as_py() for t in texts))
        names = [topics.name_of(k) for k in m.assign([s for _, s in found]).tolist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(names, pa.string())], names=["n_tokens", "topic"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType().add("n_tokens", T.LongType()).add("topic", T.StringType())).asNondeterministic()


def draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 up to 1 that depends on the id alone, or without one on the text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.sha1(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), own).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def _shares(values: np.ndarray, n: np.ndarray, names: list[str], dimension: str, targets: Targets | None) -> np.ndarray:
    """Target shares of a dimension's values."""
    if targets and dimension in targets:
        own = {NULL if k is None else k: w for k, w in targets[dimension].items()}
        t = np.array([own.get(x, 0.0) for x in names], float)
    else:
        t = np.bincount(values, n, len(names)) ** TEMPERATURE[dimension]
    return t / t.sum() if t.sum() else t


def _stalled(off: list[float]) -> bool:
    """True once all marginals hold, or no longer come closer to it."""
    return off[-1] < CLOSE or (len(off) > PATIENCE and off[-1] > 0.99 * off[-1 - PATIENCE])


def rake(cells: list[tuple[str, str, str, int]], targets: Targets | None = None) -> tuple[np.ndarray, float]:
    """The raked weight of each cell (source, lang, topic, tokens), relative to its share of all tokens, and the residual."""
    n = np.array([c[3] for c in cells], float)
    share = n / n.sum() if n.sum() else n
    w, dims = share, []
    for d, name in enumerate(DIMENSIONS):
        names, values = np.unique(np.array([c[d] for c in cells], object).astype(str), return_inverse=True)
        dims.append((values, _shares(values, n, names.tolist(), name, targets)))

    def residual() -> float:
        return max((float((np.abs(np.bincount(v, w, len(t)) - t)[t > 0] / t[t > 0]).max(initial=0.0)) for v, t in dims), default=0.0)

    off: list[float] = [residual()]
    while w.sum() and not _stalled(off):
        for values, t in dims:
            s = np.bincount(values, w, len(t))
            w = w * np.divide(t, s, out=np.ones_like(t), where=s > 0)[values]
        off.append(residual())
    return np.divide(w, share, out=np.ones_like(w), where=share > 0), off[-1]


def level(n: np.ndarray, w: np.ndarray, keep: float) -> float:
    """f with sum(n * min(1, f * w)) = keep * sum(n), or the largest useful f if even all of it is less."""
    order = np.argsort(-w, kind="stable")
    n, w = n[order].astype(float), w[order]
    total, whole, rest = n.sum(), 0.0, float((n * w).sum())
    for x, y in zip(n, w, strict=True):
        f = (keep * total - whole) / rest if rest > 0 else 1.0
        if f * y <= 1 or y <= 0:
            return max(f, 0.0)
        whole, rest = whole + x, rest - x * y
    return 1.0 / w[w > 0].min() if (w > 0).any() else 1.0


def _rake_table(cells: DataFrame, targets: Targets | None, keep: float, folder: str) -> DataFrame:
    """``rake`` and ``level`` for any number of cells."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("n")).first()[0] or 0) or 1.0
    cells = cells.withColumn("w", F.col("n") / total)
    goals = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            rows = [(NULL if k is None else k, float(v)) for k, v in targets[d].items()]
            t = cells.select(d).distinct().join(spark.createDataFrame(rows, f"{d} string, t double"), d, "left").fillna(0.0, ["t"])
        else:
            t = cells.groupBy(d).agg(F.pow(F.sum("n").cast("double"), TEMPERATURE[d]).alias("t"))
        whole = t.agg(F.sum("t")).first()[0] or 1.0
        goals[d] = written(t.withColumn("t", F.col("t") / whole), folder, f"target-{d}")
    def residual() -> float:
        miss = [cells.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d].filter("t > 0"), d).agg(F.max(F.abs(F.col("s") / F.col("t") - 1))).first()[0] for d in DIMENSIONS]
        return max(x or 0.0 for x in miss)

    off, k = [residual()], 0
    while not _stalled(off):
        for d in DIMENSIONS:
            f = cells.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d).select(d, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(1.0).alias("f"))
            cells = cells.join(f, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        cells = written(cells, folder, f"sweep-{k}")
        off.append(residual())
        k += 1
    cells = cells.withColumn("weight", F.when(F.col("n") > 0, F.col("w") * total / F.col("n")).otherwise(1.0)).drop("w")
    f = 0.0
    while True:  # each round more cells are known to stay whole
        whole, rest = cells.agg(
            F.sum(F.when(F.col("weight") * f > 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("weight") * f > 1, 0.0).otherwise(F.col("n") * F.col("weight")))
        ).first()
        new = max((keep * total - (whole or 0)) / rest, 0.0) if rest else f
        if new <= f * (1 + 1e-12):
            return cells.withColumn("f", F.lit(f)).withColumn("residual", F.lit(off[-1]))
        f = new


def cell_weights(rows: DataFrame, targets: Targets | None = None, keep: float = KEEP, max_cells: int | None = None) -> DataFrame:
    """(source, lang, topic, weight, p, residual) of all cells of ``rows`` (source, lang, topic, n_tokens); nulls are ``NULL``.

    A table of at most ``MAX_CELLS`` rows is marked for broadcast.
    """
    spark = rows.sparkSession
    bound = MAX_CELLS if max_cells is None else max_cells
    folder = shared_dir(spark)
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), folder, "cells")
    p = F.least(F.lit(1.0), F.col("f") * F.col("weight")).alias("p")
    if cells.count() > bound:
        return _rake_table(cells, targets, keep, folder).select(*DIMENSIONS, "weight", p, "residual")
    own = sorted((r["source"], r["lang"], r["topic"], r["n"]) for r in cells.collect())  # at most MAX_CELLS rows
    w, residual = rake(own, targets)
    f = float(level(np.array([c[3] for c in own]), w, keep))
    out = spark.createDataFrame([(*c[:3], float(x), f, residual) for c, x in zip(own, w, strict=True)], "source string, lang string, topic string, weight double, f double, residual double")
    return F.broadcast(written(out.select(*DIMENSIONS, "weight", p, "residual"), folder, "weights"))


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def mixed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (source, lang, topic, n_tokens, u, ...) with their cell's weight, probability and draw in the struct ``mix``."""
    mix = F.struct(F.when(F.col("topic") != NULL, F.col("topic")).alias("topic"), "n_tokens", "weight", F.col("p").alias("probability"), (F.col("u") < F.col("p")).alias("selected"))
    return rows.join(weights, list(DIMENSIONS), "left").withColumn("mix", mix)


def weighted(
    docs: DataFrame, targets: Targets | None = None, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct (topic, n_tokens, weight, probability, selected); returns that column's name too."""
    prepare(docs.sparkSession)
    measure = measured(topics.of_sample([]) if topic else topics.fit(docs.select(column(docs, text).alias("text"))))
    row = F.struct(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(
        row.alias("row"), _known(column(docs, source)).alias("source"), _known(column(docs, lang)).alias("lang"),
        draw(column(docs, doc_id), column(docs, text)).alias("u"), measure(column(docs, text)).alias("m"),
    )
    what = _known(F.col(f"row.c{docs.columns.index(topic)}")) if topic else F.col("m.topic")
    rows = rows.withColumn("topic", what).withColumn("n_tokens", F.col("m.n_tokens"))
    out = mixed(rows, cell_weights(rows.select(*DIMENSIONS, "n_tokens"), targets, keep))
    name = fresh(docs, "mix")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("mix").alias(name)), name


def sample(docs: DataFrame, targets: Targets | None = None, keep: float = KEEP) -> DataFrame:
    """The sampled documents, with ``docs``'s own columns."""
    out, m = weighted(docs, targets, keep)
    return out.filter(F.col(f"`{m}`.selected")).select(*[column(out, c) for c in docs.columns])


def op6_mixing_ipf(spark, sf_dir: str) -> DataFrame:
    """The calibrated weight and draw of each of all ``documents``; words are counted once, into a narrow table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    measure = measured(topics.fit(docs.select("text")))
    rows = docs.select("doc_id", _known(docs.source).alias("source"), _known(docs.lang).alias("lang"), draw(docs.doc_id, docs.text).alias("u"), measure("text").alias("m"))
    rows = written(rows.select("doc_id", "source", "lang", "u", "m.topic", "m.n_tokens"), shared_dir(spark), "rows")
    out = mixed(rows, cell_weights(rows))
    plain = lambda c: F.when(F.col(c) != NULL, F.col(c)).alias(c)
    return out.select("doc_id", plain("source"), plain("lang"), "mix.topic", "mix.n_tokens", F.round("mix.weight", 6).alias("weight"), F.round("mix.probability", 6).alias("probability"), "mix.selected")
