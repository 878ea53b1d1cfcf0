"""Toxicity by maximum-scoring segment search.

Fit (``fit``), from labelled documents:

1. Token counts of toxic and of clean documents give candidates: tokens with at least ``MIN_SHARE`` of all toxic tokens
   (so at most 1 / MIN_SHARE of them) that stand out.
2. Candidates get log-odds with an informative Dirichlet prior, whose pseudo-counts follow the token's frequency in
   the whole corpus. Here a token counts once per distinct pair of neighbours, so copies and near copies of one
   document count as one. Tokens of z-score ``MIN_Z`` or more are the lexicon.
3. A toxic passage is modelled as ``DENSITY`` lexicon tokens among background tokens, so a token's score is
   log(DENSITY * odds ratio + 1 - DENSITY) and any other token's is log(1 - DENSITY): the expected score is negative.
4. Karlin-Altschul parameters: lambda solves sum(p * exp(lambda * score)) = 1 over clean text, and K is matched to how
   often clean documents exceed the smallest positive score.

Scan: one linear pass per whole text (Ruzzo and Tompa) finds all maximal-scoring segments; a segment of score s among
n tokens has the expected count E = K * n * exp(-lambda * s), and is a passage if E <= ``MAX_E``. A document's
evidence is the largest -log(p) of the sum statistic t = lambda * (sum of scores) - r * log(K n) over its r best
segments, where p = exp(-t) * t ** (r - 1) / (r! * (r - 1)!); its score is the share of toxic documents at that evidence, monotone by pooling (fitted on bounded bins of evidence).

At most ``FIT_ROWS`` labelled rows are fitted on (those of least hash; a broadcast of that size at most); corpus counts
cover all documents, and all of every text is scanned.

Defined cases: null and empty texts have no segments and get the score of no evidence; labels that are null, repeated
(the largest counts) or name no document are harmless; without toxic or without clean labels the lexicon is empty and
every score is the share of toxic labels (0 without any); null ids carry no label; repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, prepare, shared_dir, table, written

FIT_ROWS = 200_000
MIN_SHARE = 1 / 50_000
MIN_Z = 3.0
PRIOR = 500.0  # pseudo-counts in all, dealt out by frequency in the corpus
FLOOR = 0.5  # and as many for each token beside them, so that a token unseen in a class has a finite variance
DENSITY = 0.1
MAX_E = 0.05
FLUSH = 200_000  # distinct tokens that a task counts before it passes them on
THRESHOLD = 0.3

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Scores by token, the score of other tokens, the Karlin-Altschul parameters and the calibration's steps."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = math.log(1 - DENSITY)
    lam: float = 1.0
    k: float = 0.1
    edges: list[float] = field(default_factory=list)
    levels: list[float] = field(default_factory=lambda: [0.0])


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text whose tokens score ``other`` except at ``hits``.

    Ruzzo and Tompa's scan; the tokens between two hits are one step. ``link`` leads from each kept segment to the last
    one before it of a smaller sum before it. A search follows links and never meets again what it passed, so the scan is
    linear in the hits.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    link: list[int] = []
    total, at = 0.0, -1
    for i, s in hits:
        total += other * (i - at - 1)
        at = i
        left, total = total, total + s
        if s <= 0:
            continue
        new, j = (i, i, left, total), len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = link[j]
            if j < 0 or kept[j][3] >= total:
                kept.append(new)
                link.append(j)
                break
            new, before = (kept[j][0], i, kept[j][2], total), link[j]
            del kept[j:], link[j:]
            j = before
    return [(a, b, r - x) for a, b, x, r in kept]


def evidence(found: list[tuple[int, int, float]], n: int, m: Model) -> float:
    """The largest -log(p) of the sum statistics over the r best segments; 0 for none."""
    best, total, base = 0.0, 0.0, math.log(max(m.k * n, 1e-9))
    for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
        total += m.lam * s - base
        if total > 0:
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def passages(text: str | None, m: Model) -> tuple[int, list[tuple[int, int, float]], float]:
    """Tokens, maximal segments in token numbers, and evidence of one whole text."""
    words = WORD.findall((text or "").lower())
    known = m.scores
    hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
    found = segments(hits, m.other) if hits else []
    return len(words), found, evidence(found, len(words), m) if found else 0.0


def spans(text: str | None, m: Model) -> list[tuple[int, int, float]]:
    """The significant passages of a text as (start, end, expected count), in code points."""
    n, found, _ = passages(text, m)
    if not found:
        return []
    at = [x.span() for x in WORD.finditer(text or "")]
    if len(at) != n:  # a letter whose lower case has several characters, or none that is a letter
        at = [x.span() for x in WORD.finditer((text or "").lower())]
    e = [(at[a][0], at[b][1], m.k * n * math.exp(-m.lam * s)) for a, b, s in found]
    return [x for x in e if x[2] <= MAX_E]


def calibrated(x: float, m: Model) -> float:
    """Share of toxic documents at that evidence; a hair of the evidence itself orders equal shares."""
    return 0.999 * m.levels[bisect_right(m.edges, x)] + 0.001 * (1 - math.exp(-max(x, 0.0) / 50))


def fit_labels(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """At most ``FIT_ROWS`` labelled ids (``id``, ``y``) to learn from: crc32 of the id's text mod 4 is not 2."""
    rows = labels.select(column(labels, doc_id).alias("id"), column(labels, toxic).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    rows = rows.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    return rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def out() -> pa.RecordBatch:
        rows = [(w, y, n) for y, c in counts.items() for w, n in c.items()]
        for c in counts.values():
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["token", "y", "n"])

    for batch in batches:
        for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            counts[1 if y else 0].update(set(WORD.findall((t.as_py() or "").lower())))
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield out()
    yield out()


def _contexts(candidates: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_words, seen = 0, Counter()
        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words = WORD.findall((t.as_py() or "").lower())
                all_words += len(words)
                at = [i for i, w in enumerate(words) if w in candidates]
                seen.update(words[i] for i in at)
                if y is not None:
                    for i in at:
                        near = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                        rows.append((words[i], 1 if y else 0, xxhash.xxh64_intdigest(near) >> 1))
            yield _batch(rows)
        yield _batch([(w, 2, n) for w, n in seen.items()] + [("", 2, all_words)])

    def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["token", "y", "v"])

    return run


def _evidence_udf(m: Model):
    def run(texts: pa.Array) -> pa.Array:
        rows = [passages(t.as_py(), m) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([max((s[2] for s in r[1]), default=0.0) for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())],
            names=["n", "best", "evidence"],
        )

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("evidence", T.DoubleType())])
    return F.arrow_udf(run, kind).asNondeterministic()


def _pooled(bins: list[tuple[float, int, int]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over (evidence, documents, toxic), least evidence first: levels, and the edges midway."""
    blocks: list[list[float]] = []  # first and last evidence, documents, toxic
    for x, n, y in bins:
        blocks.append([x, x, n, y])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, x2, n2, y2 = blocks.pop()
            blocks[-1][1] = x2
            blocks[-1][2] += n2
            blocks[-1][3] += y2
    return [(a[1] + b[0]) / 2 for a, b in zip(blocks, blocks[1:], strict=False)], [b[3] / b[2] for b in blocks]


def _lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * score)) = 1."""
    if not len(scores) or scores.max() <= 0 or (scores * p).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700.0))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled documents; ``labels`` as ``fit_labels`` returns them."""
    prepare(docs.sparkSession)
    m = Model()
    docs = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text"))
    folder = shared_dir(docs.sparkSession)
    labels = F.broadcast(written(labels, folder, "labels"))  # at most FIT_ROWS rows
    known = docs.join(labels, "id").select("text", "y")
    sums = known.mapInArrow(_count, "token string, y int, n long").groupBy("token").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("b")
    )
    sums = written(sums, folder, "tokens")
    n1, n0 = sums.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    standing = sums.filter((F.col("a") >= max(3, MIN_SHARE * n1)) & (F.col("a") * n0 > 2 * F.col("b") * n1))
    candidates = frozenset(r["token"] for r in standing.select("token").collect())  # at most 1 / MIN_SHARE rows
    y1: Counter = Counter()
    y0: Counter = Counter()
    corpus: Counter = Counter()
    if candidates:
        seen = docs.join(labels, "id", "left").select("text", "y").mapInArrow(_contexts(candidates), "token string, y int, v long")
        kinds = seen.filter("y < 2").groupBy("token", "y").agg(F.countDistinct("v").alias("n"))
        counts = seen.filter("y = 2").groupBy("token", "y").agg(F.sum("v").alias("n"))
        for r in kinds.union(counts).collect():  # at most three rows a candidate
            (y0, y1, corpus)[r["y"]][r["token"]] = r["n"]
    words = max(1, corpus.pop("", 1))
    t1, t0 = max(sum(y1.values()), n1, 1), max(sum(y0.values()), n0, 1)
    for w in candidates:
        prior = FLOOR + PRIOR * corpus[w] / words
        a, b = y1[w] + prior, y0[w] + prior
        delta = math.log(a / max(t1 + PRIOR - a, 1)) - math.log(b / max(t0 + PRIOR - b, 1))
        if delta / math.sqrt(1 / a + 1 / b) >= MIN_Z:
            m.scores[w] = math.log(DENSITY * math.exp(min(delta, 12.0)) + 1 - DENSITY)
    if m.scores:
        p = np.array([(y0[w] + 0.5) / t0 for w in m.scores])
        m.lam = _lambda(np.array([*m.scores.values(), m.other]), np.array([*p, max(1e-9, 1 - p.sum())]))
        least = min(m.scores.values())
        clean = known.filter("y = 0").select(_evidence_udf(m)("text").alias("e"))
        n, over = clean.agg(F.sum("e.n"), F.sum((F.col("e.best") >= least - 1e-9).cast("long"))).first()
        m.k = max((over or 0) + 0.5, 0.5) / (max(n or 0, 1) * math.exp(-m.lam * least))
    scored = known.select("y", F.round(_evidence_udf(m)("text")["evidence"] * 4).alias("bin"))
    bins = scored.groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("y")).collect()  # evidence in quarters
    if bins:
        m.edges, m.levels = _pooled(sorted((r["bin"] / 4, r["n"], r["y"]) for r in bins))
    return m


def score(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``toxicity`` (or a longer name): score, evidence, passages (start, end, e)."""
    prepare(docs.sparkSession)
    at = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("e", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T.ArrayType(at))])

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py()
            _, found, x = passages(t, m)
            where = [{"start": a, "end": b, "e": e} for a, b, e in spans(t, m)] if found else []
            rows.append({"score": calibrated(x, m), "evidence": x, "passages": where})
        a = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e", pa.float64())])
        return pa.array(rows, pa.struct([("score", pa.float64()), ("evidence", pa.float64()), ("passages", pa.list_(a))]))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(fresh(docs, "toxicity"), F.arrow_udf(run, kind).asNondeterministic()(column(docs, text)))


def op2_toxicity_segments(spark, sf_dir: str) -> DataFrame:
    """The toxicity of each of all ``documents``, learned from the labels of three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = fit(docs, fit_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    s = F.col("toxicity.score")
    return score(docs, m).select("doc_id", held.alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"), F.size("toxicity.passages").alias("n_passages"))
