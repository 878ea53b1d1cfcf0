"""Secret scans: base patterns and a randomness test battery with false-discovery control.

Base spans, per kind leftmost and non-overlapping: ``assign`` (a key word, ``:`` or ``=``, a value of 12 or more
characters), ``access`` (``AKIA`` and 14 or more characters) and ``hex`` (16 or more lower-case hex digits).

The battery adds spans of kind ``random``. A run is a stretch of the base64 alphabets (``=`` ends it); what base spans
cover is cut out of it. Candidates are the rest's maximal parts of ``LEAST`` or more characters in each of three alphabets
(letters and digits; with ``+/``; with ``-_``), so neither a path nor a mixture of alphabets hides a key. Of candidates that
overlap the one of least p-value is reported. A candidate's encoding is the smallest alphabet that holds it (hex in either
case, base32, base 62, base64, base64url; digits alone are none). Over that alphabet's values three statistics are taken:
chi-squared against uniform characters, the runs about the middle and the lag-1 serial correlation.

* A gate: under randomness the three have two-sided p-values; Fisher's combination must not fall below ``MIN_RANDOM``.
* The discovery: the null is text, whose characters and pairs of characters follow the corpus's own counts within the
  alphabet. Under it each statistic of a run of n characters has a mean and a spread that depend on n; its z-score says
  how far the run lies from text towards randomness. The three z-scores are combined with the distances between text and
  randomness at that length as weights (Liptak), so a test counts as much as it can tell the two apart in that alphabet,
  and short runs can't be significant.
* Benjamini and Hochberg's rule at ``FDR`` over all candidates of all documents gives the p-value up to which
  candidates are reported; p-values are counted in bins of a twentieth of a power of ten, rounded up.

Three passes over whole texts: character pairs, p-values, spans. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; repeated rows and ids are scanned row by row; null ids pass
through; an empty table gives an empty result; ``find`` keeps all columns and names its own so that none clashes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, prepare, table

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones needn't be matched to be dropped
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PARTS = re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9]{20,}")
KINDS = ("assign", "access", "hex", "random")
MIN_RANDOM = 0.001
FDR = 0.01
BINS = 20  # to a power of ten

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_VALUES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(run: str) -> str | None:
    chars = set(run)
    if not chars or chars <= frozenset(_DIGITS):
        return None
    return next((k for k, s in _SETS.items() if chars <= s), None)


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail, by Wilson and Hilferty."""
    v = 2 / (9 * df)
    return _normal(-(((max(x, 0.0) / df) ** (1 / 3) - (1 - v)) / math.sqrt(v)))


def battery(run: str, kind: str) -> tuple[float, float, float, float]:
    """The chi-squared statistic of uniformity, the number of changes between the halves of the alphabet, the serial
    correlation, and the combined p-value of randomness."""
    size, values = len(ENCODINGS[kind]), _VALUES[kind]
    v = [values[c] for c in run]
    n = len(v)
    chi2 = sum(c * c for c in Counter(v).values()) * size / n - n
    high = [2 * x >= size for x in v]
    n1 = sum(high)
    n0 = n - n1
    changes = sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * n1 * n0 / n
    var = mean * (mean - 1) / (n - 1) if n > 1 else 0.0
    p_runs = 2 * _normal(-abs(changes - mean) / math.sqrt(var)) if var > 0 else 0.0
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    r = sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / spread if spread else 1.0
    p_serial = 2 * _normal(-abs(r) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (_chi2_tail(chi2, size - 1), p_runs, p_serial))
    return chi2, changes, r, _chi2_tail(fisher, 6)


@dataclass
class Law:
    """Text within one alphabet: mean m0 + n * m1 and variance v0 + n * v1 of the chi-squared statistic of n characters,
    the share of pairs that change halves, and the correlation of neighbours."""

    size: int
    m0: float
    m1: float
    v0: float
    v1: float
    change: float
    serial: float

    def p_value(self, n: int, chi2: float, changes: float, r: float) -> float:
        """Of a run at least as far from text towards randomness, by the three statistics together."""
        q = min(max(self.change, 0.01), 0.99)
        s_chi2, s_change, s_serial = math.sqrt(self.v0 + n * max(self.v1, 0.0)), math.sqrt((n - 1) * q * (1 - q)), 1 / math.sqrt(n)
        # distances from text to randomness, in the statistic's spread under text
        d = ((self.size - 1 - self.m0 - n * self.m1) / s_chi2, (n - 1) * (0.5 - q) / s_change, -self.serial / s_serial)
        z = ((chi2 - self.m0 - n * self.m1) / s_chi2, (changes - (n - 1) * q) / s_change, (r - self.serial) / s_serial)
        weight = math.sqrt(sum(x * x for x in d))
        return _normal(-sum(x * y for x, y in zip(d, z, strict=True)) / weight) if weight > 0 else 1.0


def laws_of(pairs: np.ndarray) -> dict[str, Law]:
    """The laws of text from the corpus's counts of byte pairs (256, 256), by encoding."""
    out = {}
    for k, alphabet in ENCODINGS.items():
        size, at = len(alphabet), [ord(c) for c in alphabet]
        joint = pairs[np.ix_(at, at)] + 0.5 / size
        p = joint.sum(axis=1) + joint.sum(axis=0)
        p /= p.sum()
        joint = joint / joint.sum()
        u, half, v = 1 / size, 2 * np.arange(size) >= size, np.arange(size)
        a, b = joint.sum(axis=1), joint.sum(axis=0)
        spread = math.sqrt(((a * v**2).sum() - (a * v).sum() ** 2) * ((b * v**2).sum() - (b * v).sum() ** 2))
        serial = ((joint * np.outer(v, v)).sum() - (a * v).sum() * (b * v).sum()) / spread if spread else 0.0
        out[k] = Law(
            size, float((p * (1 - p)).sum() / u), float(((p - u) ** 2).sum() / u), 2.0 * (size - 1),
            float(4 * ((p**3).sum() / u**2 - ((p**2).sum() / u) ** 2)), float(joint[half[:, None] != half[None, :]].sum()), float(serial),
        )
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of what base spans leave of each run, in its maximal parts of each alphabet."""
    cover, i = _union(base), 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while i < len(cover) and cover[i][1] <= at:
            i += 1
        j, free = i, []
        while j < len(cover) and cover[j][0] < end:
            free.append((at, cover[j][0]))
            at = cover[j][1]
            j += 1
        free.append((at, end))
        parts = {x.span() for a, b in free if b - a >= LEAST for p in PARTS for x in p.finditer(text, a, b)}
        for a, b in sorted(parts):
            yield a, b, text[a:b]


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def p_value(run: str, laws: dict[str, Law]) -> float | None:
    """The candidate's p-value as text; 1 if it isn't random either, None without an encoding."""
    kind = encoding(run)
    if kind is None:
        return None
    chi2, changes, r, random = battery(run, kind)
    return laws[kind].p_value(len(run), chi2, changes, r) if random >= MIN_RANDOM else 1.0


def _bin(p: float) -> int:
    """The bin of a p-value; its upper edge is 10 ** (-bin / BINS)."""
    return min(int(-math.log10(max(p, 1e-300)) * BINS), 300 * BINS)


def cut(bins: dict[int, int]) -> float:
    """The least bin (largest p-value) that Benjamini and Hochberg's rule reports; infinite for none."""
    total, seen, best = sum(bins.values()), 0, math.inf
    for k in sorted(bins, reverse=True):
        seen += bins[k]
        if 10 ** (-k / BINS) <= FDR * seen / total:
            best = k
    return best


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for t in batch.column(0):
            if t.is_valid:
                raw = np.frombuffer(t.as_buffer(), np.uint8).astype(np.int32)
                counts += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
    pair = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(pair, pa.int64()), "n": pa.array(counts[pair], pa.int64())})


def _p_bins(laws: dict[str, Law]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py() or ""
                if RUN.search(text):
                    ps = (p_value(r, laws) for _, _, r in candidates(text, base_spans(text)))
                    bins.update(_bin(p) for p in ps if p is not None)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(list(bins), pa.int64()), "n": pa.array(list(bins.values()), pa.int64())})

    return run


def fit(df: DataFrame, text: str = "text") -> tuple[dict[str, Law], float]:
    """The corpus's laws of text and the bin from which candidates are reported."""
    prepare(df.sparkSession)
    texts = df.select(column(df, text).alias("text"))
    pairs = np.zeros(1 << 16, np.int64)
    for r in texts.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 2 ** 16 rows
        pairs[r["pair"]] = r["n"]
    laws = laws_of(pairs.reshape(256, 256))
    rows = texts.mapInArrow(_p_bins(laws), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # at most 300 * BINS rows
    return laws, cut({r["bin"]: r["n"] for r in rows})


def spans_of(text: str | None, laws: dict[str, Law], least: float) -> list[tuple[int, int, int]]:
    """All spans (start, kind's place, end) of a whole text, by start and then kind."""
    text = text or ""
    out = base_spans(text)
    if least < math.inf and RUN.search(text):
        tested = sorted((p, a, b) for a, b, run in candidates(text, out) if (p := p_value(run, laws)) is not None and _bin(p) >= least)
        found: list[tuple[int, int]] = []
        for _, a, b in tested:
            i = bisect_left(found, (a, b))
            if (not i or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
                found.insert(i, (a, b))
        out += [(a, 3, b) for a, b in found]
        out.sort()
    return out


def find(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a column of spans (kind, start, end); returns that column's name too."""
    laws, least = fit(df, text)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t.as_py(), laws, least)] for t in texts], inner)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    name = fresh(df, "secrets")
    return df.withColumn(name, F.arrow_udf(run, kind).asNondeterministic()(column(df, text))), name


def op5_secret_tests(spark, sf_dir: str) -> DataFrame:
    """The secrets in every text of ``documents``."""
    out, s = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda x: F.array_join(F.transform(x, lambda r: F.concat_ws(":", r.kind, r.start.cast("string"), r.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter(s, lambda r: r.kind == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter(s, lambda r: r.kind != "random"))
    return out.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), joined(F.col(s)).alias("spans"))
