"""An index of vectors: cells around centres, of which a search visits the nearest ones.

The centres are fitted on at most ``FIT_ROWS`` vectors, those of least hash of their id (a bound of what the driver holds);
every vector of the table is then given its cell. A search broadcasts blocks of questions with the cells that each visits; a
task compares a vector only with the questions that visit its cell, so a large cell is spread over all tasks that read it, and with
the table stored by cell (``write``) only visited cells are read. ``recall`` measures a search against the exact one.

Defined cases: null vectors and those of another length than the first centre's are left out; fewer vectors than cells give as
many cells as there are; an empty table gives an empty index and no neighbours; ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.operators.retrieval import BLOCK, RETRIEVAL_K, Nearest, found_rows, ranked, rows_of

FIT_ROWS = 50_000
STEPS = 15
CELLS = 64
PROBES = 48  # vectors without clusters need most of the cells: 0.98 of the neighbours of sf0.1 in 48 of 64, 0.69 in 16


def fit(vectors: DataFrame, cells: int = CELLS, rows: int = FIT_ROWS) -> np.ndarray:
    """Centres (cells, size) by Lloyd's iteration on at most ``rows`` vectors (chunk_id, embedding)."""
    some = vectors.filter("embedding IS NOT NULL").select(F.xxhash64("chunk_id").alias("h"), F.col("embedding").cast("array<double>").alias("embedding"))
    got = some.orderBy("h").limit(rows).toArrow().column("embedding").to_pylist()  # at most ``rows`` vectors
    size = len(got[0]) if got else 0
    if not size:
        return np.zeros((0, 0))
    v = np.unique(np.array([x for x in got if len(x) == size], np.float64), axis=0)
    centres = v[np.random.default_rng(42).permutation(len(v))[:cells]]
    for _ in range(STEPS if len(v) > cells else 0):
        own = _cells(v, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _cells(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * v @ centres.T).argmin(axis=1)


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every vector (chunk_id, embedding, ...) with its ``cell``."""
    size = centres.shape[1] if len(centres) else 0

    def run(embedding: pa.Array) -> pa.Array:
        out = np.full(len(embedding), -1)
        if len(centres):
            rows, v = rows_of(pa.RecordBatch.from_arrays([embedding], names=["embedding"]), size)
            out[rows] = _cells(v, centres)
        return pa.array(out, pa.int32())

    run.__annotations__ = {"embedding": pa.Array, "return": pa.Array}
    rows = vectors.filter("embedding IS NOT NULL")
    return rows.withColumn("cell", F.arrow_udf(run, T.IntegerType())("embedding")).filter("cell >= 0")


def write(vectors: DataFrame, path: str, cells: int = CELLS) -> np.ndarray:
    """Store the index under ``path``, by cell; returns the centres."""
    centres = fit(vectors, cells)
    assigned(vectors, centres).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    return centres


def open_index(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row a cell
    return spark.read.parquet(f"{path}/vectors"), np.array([r["centre"] for r in rows], np.float64)


def _search(ids: pa.Array, asked: np.ndarray, visits: np.ndarray, k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(asked, k)
        for b in batches:
            rows, v = rows_of(b, asked.shape[1])
            cell = b.column("cell").to_numpy(zero_copy_only=False)[rows]
            for c in np.unique(cell):
                who, at = np.flatnonzero((visits == c).any(axis=1)), np.flatnonzero(cell == c)
                if len(who):
                    near.show(v[at], b.column("chunk_id").take(pa.array(rows[at])).to_pylist(), questions=who)
        yield found_rows(near, ids, schema)

    return run


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = RETRIEVAL_K, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """The nearest ``k`` of the vectors in the ``probes`` cells nearest to each of ``queries`` (query_id, embedding)."""
    spark = index.sparkSession
    queries = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", index.schema["chunk_id"].dataType), T.StructField("raw_score", T.DoubleType())])
    out, blocks = spark.createDataFrame([], kinds), max(1, -(-queries.count() // block)) if len(centres) else 0
    for i in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()  # about ``block`` rows
        if not asked.num_rows:
            continue
        q = np.array(asked.column("embedding").to_pylist(), np.float64)
        far = (centres**2).sum(axis=1)[None, :] - 2 * q @ centres.T
        visits = np.argsort(far, axis=1, kind="stable")[:, :probes]
        of_kind = to_arrow_schema(kinds)
        ids = asked.column("query_id").combine_chunks().cast(of_kind.field("query_id").type)
        rows = index.filter(F.col("cell").isin(np.unique(visits).tolist())).select("chunk_id", "embedding", "cell")
        out = out.unionByName(rows.mapInArrow(_search(ids, q, visits, k, of_kind), kinds))
    top = ranked(out, k, F.round("raw_score", 12), F.col("chunk_id"))
    return top.select("query_id", "chunk_id", F.lit("semantic").alias("source_retriever"), "original_rank", "raw_score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: questions, and the share of the exact neighbours (query_id, chunk_id) that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_questions"), (F.count("hit") / F.count("*")).alias("recall"))
