"""Topics of texts, for the marginals that sources are mixed to: a mixture of multinomials over hashed words, by hard EM.

A text is the set of its words' hash buckets (``BUCKETS``). A topic scores it by the sum of log((n + 1) / (N + BUCKETS)),
where n of the topic's N counted buckets are the one at hand; the text has the topic of the largest score (ties: the
first). Scores are whole numbers of 2 ** -20, so sums don't depend on their order.

The start is fitted on the ``SEED_ROWS`` distinct texts of least hash (the bound of what the driver holds); then the counts of
every topic are taken over all texts, ``PASSES`` times, and every text is assigned. Topics are numbered by size.

Defined cases: texts without words have the topic ``none``; copies are counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.simhash_golay import BLOCK_BYTES, words, xxh64

TOPICS = 8
BUCKETS = 1024
SEED_ROWS = 2048
STARTS, STEPS = 6, 12  # of the fit on the seed rows
PASSES = 1
NONE = "none"


@dataclass
class Topics:
    """Scores (topics, buckets) in units of 2 ** -20."""

    scores: np.ndarray

    def assign(self, sets: list[np.ndarray]) -> np.ndarray:
        """The topic's number of each set of buckets; -1 for an empty one."""
        out = np.full(len(sets), -1)
        some = [i for i, s in enumerate(sets) if len(s)]
        if some:
            first = np.cumsum([0, *[len(sets[i]) for i in some]])[:-1]
            out[some] = np.argmax(np.add.reduceat(self.scores[:, np.concatenate([sets[i] for i in some])], first, axis=1), axis=0)
        return out


def of_counts(n: np.ndarray) -> Topics:
    return Topics(np.rint(np.log((n + 1) / (n.sum(axis=1, keepdims=True) + BUCKETS)) * (1 << 20)).astype(np.int64))


def bucket_sets(texts: Iterator[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the sorted distinct buckets of each whole text."""
    block, held = [], 0
    for t in texts:
        block.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            yield from _block(block)
            block, held = [], 0
    if block:
        yield from _block(block)


def _block(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    data, start, stop, n = words(texts)
    bucket = (xxh64(data, start, stop - start) >> np.uint64(54)).astype(np.int64)  # the upper 10 bits: BUCKETS
    key = np.unique(np.repeat(np.arange(len(texts)), n) * BUCKETS + bucket)
    at = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    for i, k in enumerate(n.tolist()):
        yield k, key[at[i] : at[i + 1]] % BUCKETS


def of_sample(sets: list[np.ndarray]) -> Topics:
    """The best of ``STARTS`` fits on a sample."""
    rows = np.zeros((len(sets), BUCKETS), np.int64)
    for i, s in enumerate(sets):
        rows[i, s] = 1
    best, most = of_counts(np.zeros((TOPICS, BUCKETS), np.int64)), None
    rng = np.random.default_rng(42)
    for _ in range(STARTS if len(sets) >= TOPICS else 0):
        m = of_counts(20 * rows[rng.choice(len(sets), TOPICS, replace=False)])
        for _ in range(STEPS):
            fit = rows @ m.scores.T
            n = np.zeros((TOPICS, BUCKETS), np.int64)
            np.add.at(n, fit.argmax(axis=1), rows)
            m = of_counts(n)
        total = int((rows @ m.scores.T).max(axis=1).sum())
        if most is None or total > most:
            best, most = m, total
    return best


def _counts(m: Topics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((TOPICS, BUCKETS), np.int64)
        for batch in batches:
            sets = [s for _, s in bucket_sets(t.as_py() for t in batch.column(0)) if len(s)]
            for k, s in zip(m.assign(sets).tolist(), sets, strict=True):
                n[k, s] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int64()), "n": pa.array(n.ravel()[at], pa.int64())})

    return run


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tolist() for _, s in bucket_sets(t.as_py() for t in batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["h", "buckets"])


def fit(texts: DataFrame) -> Topics:
    """Topics of the column ``text``."""
    texts = texts.select("text").filter("text <> ''")
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    least = F.broadcast(hashed.select("h").distinct().orderBy("h").limit(SEED_ROWS))
    rows = hashed.join(least, "h", "left_semi").mapInArrow(_seed, "h long, buckets array<long>").groupBy("h").agg(F.first("buckets").alias("buckets"))
    sample = [np.array(r["buckets"], np.int64) for r in sorted(rows.collect(), key=lambda r: r["h"])]  # SEED_ROWS sets of at most BUCKETS
    m = of_sample([s for s in sample if len(s)])
    for _ in range(PASSES):
        n = np.zeros(TOPICS * BUCKETS, np.int64)
        for r in texts.mapInArrow(_counts(m), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # TOPICS * BUCKETS rows
            n[r["place"]] = r["n"]
        n = n.reshape(TOPICS, BUCKETS)
        m = of_counts(n[np.argsort(-n.sum(axis=1), kind="stable")])
    return m


def name_of(k: int) -> str:
    return f"t{k}" if k >= 0 else NONE
