"""Near copies by the exact Jaccard similarity of word shingles: SimHash and Golay keys find the nearest, MinHash bands the others.

A text is the set of its shingles of ``SIZE`` words (fewer words: the whole sequence), each a 64-bit hash. Texts with the
same set are one node. Two sets are linked if they share ``SIMILAR`` of their union, counted on the sets themselves.

First operator 10's method: each set has a fingerprint of 64 bits, a bit is 1 if set in over half of its shingles' hashes, and
fingerprints within 2 bits are found by their Golay keys (``simhash_golay.links``). Of them the larger set of each fingerprint and, of sets of
one fingerprint, each with the largest are counted exactly. Sets of similarity 0.8 have fingerprints that differ in 10 bits on average (64 acos(8/9) / pi), so
a second search finds what this radius can't reach; it compares only sets that the first has left in different components.

There candidates share one of ``BANDS`` keys of ``ROWS`` minima each. A pair of similarity s is no candidate with probability
(1 - s^5)^30: 7 in a million at 0.8, less above. In a bucket of at most ``BUCKET`` sets all pairs are counted. In a larger
one every set X first meets one centre C, the same for the buckets of a group: each member names, of the sets that share most keys in
one of its buckets, the one with the most, and a bucket takes what most of its members name. In a group of copies that is the text that
the others were made of, or the nearest to it. What this links is one component. A set X
outside it isn't similar to C, and then it is similar only to sets that differ from C in the same places: with the difference D(X)
of X and C, X and Y differ in |D(X)| + |D(Y)| - 2 t shingles if t are in both differences. As they must differ in at most a fifth
of their union, of at most |X u C| + |D(Y)| - t shingles, and |D(X)| > |X u C| / 5,

    t >= |D(X)| - |X u C| / 5   and   t >= 0.8 |D(Y)| / 1.8.

So X shares with each such Y one of the rarest |D| - t + 1 shingles of both differences (prefix filtering). For each of its own ones X
first meets the one set that has it and the fewest other differences; in a group of copies this links almost all that is linked at
all. Sets that are still in different components are then joined with all that share one (with the pair's own
t = (|D(X)| - |X u C| / 5 + 0.8 |D(Y)|) / 1.8), and the pairs are counted like the others. No pair of a bucket is left out. Differences and first
meetings grow with the members of a group; the last join can grow faster, but only with those sets that stay apart from its centre.

Defined cases: null and empty texts have the empty set and are copies of each other; ids and rows as in ``simhash_golay``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm import simhash_golay
from vellumine.llm.common import column, prepare, shared_dir, written
from vellumine.llm.simhash_golay import _P1, _P2, _P3, BLOCK_BYTES, _bit_counts, _rotl, components, keep_least, row_hash, words, xxh64

SIZE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 30
BUCKET = 16
BROADCAST_ROWS = 1 << 21  # as many 64-bit row hashes are sent to all executors; more are joined by an exchange
_CHUNK = 1 << 12
_R = np.random.default_rng(42)
_XOR = _R.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)
_ODD = _R.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _block(texts: list[bytes]) -> list[np.ndarray]:
    data, start, stop, n_words = words(texts)
    w = xxh64(data, start, stop - start)
    out, at = [], 0
    for n in n_words.tolist():
        own, at = w[at : at + n], at + n
        k = min(n, SIZE)
        h = own[: n - k + 1].copy() if n else own
        for j in range(1, k):
            h = _rotl(h, 27) * _P1 + own[j : n - k + 1 + j]
        out.append(np.unique(_mix(h)))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, block, held = [], [], 0
    for t in texts:
        block.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            out += _block(block)
            block, held = [], 0
    return out + (_block(block) if block else [])


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set; that of an empty set is zero."""
    n = np.array([len(s) for s in sets], np.int64)
    out, full = np.zeros(len(sets), np.uint64), np.flatnonzero(n)
    if len(full):
        counts = _bit_counts(np.concatenate([sets[k] for k in full]), np.cumsum(n[full]) - n[full])
        out[full] = np.packbits((2 * counts > n[full][:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set; an empty set has none."""
    if not len(s):
        return np.zeros(0, np.uint64)
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _CHUNK):
        least = np.minimum(least, ((low[i : i + _CHUNK] ^ _XOR) * _ODD).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mix(_rotl(key, 27) * _P1 + row.astype(np.uint64))
    return key


def _lists(rows: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(values, pa.int64()))


def _sets(texts: pa.Array) -> pa.Array:
    sets = shingle_sets(texts.to_pylist())
    name = np.array([np.bitwise_xor.reduce(_mix(s + _P1)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    n = pa.array([len(s) for s in sets], pa.int32())
    fp = pa.array(fingerprints(sets).view(np.int64), pa.int64())
    return pa.StructArray.from_arrays([pa.array(name, pa.int64()), n, fp, _lists([band_keys(s) for s in sets]), _lists(sets)], ["s", "n", "fp", "keys", "shingles"])


_sets.__annotations__ = {"texts": pa.Array, "return": pa.Array}
_LONGS = T.ArrayType(T.LongType())
_KIND = T.StructType().add("s", T.LongType()).add("n", T.IntegerType()).add("fp", T.LongType()).add("keys", _LONGS).add("shingles", _LONGS)
sets_udf = F.arrow_udf(_sets, _KIND).asNondeterministic()


def _close(a: str, b: str):
    """Sets of these sizes can be similar."""
    return F.least(a, b) >= F.lit(SIMILAR) * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x"))
    y = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(both >= F.lit(SIMILAR) * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _candidates(df: DataFrame, text: str, owns: DataFrame) -> DataFrame:
    """The sets of the rows whose hash is in ``owns``: their texts are read again, so shingles of other rows are never kept."""
    some = df.select(row_hash(df).alias("own"), column(df, text).alias("t"))
    few = owns.count() <= BROADCAST_ROWS
    some = some.join(F.broadcast(owns) if few else owns, "own", "left_semi").select(sets_udf("t").alias("x"))
    return some.select("x.s", "x.n", "x.shingles").dropDuplicates(["s"])


def links(sets: DataFrame, shingles, folder: str) -> DataFrame:
    """Links (a, b) that connect all sets which are similar and share a key; ``sets`` has distinct ``s``, n, fp, keys and own.

    ``shingles`` gives the sets (s, n, shingles) of a table of own.
    """
    keys = sets.select("s", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = written(keys.join(shared, "key"), folder, "members")
    few, many = members.filter(F.col("m") <= BUCKET), members.filter(F.col("m") > BUCKET).select("key", "s", "n")
    a, b = few.select("key", F.col("s").alias("a"), F.col("n").alias("na")), few.select("key", F.col("s").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & _close("na", "nb")).select("a", "b")
    nearest = written(_nearest(sets, f"{folder}/golay"), folder, "nearest")
    some = members.select("s").union(nearest.select("a")).union(nearest.select("b")).distinct()
    owns = written(sets.select("s", "own").join(some, "s", "left_semi").select("own"), folder, "owns")
    candidates = written(shingles(owns), folder, "candidates")
    found = written(_verified(nearest, candidates), folder, "links-0")
    shares = members.groupBy("s").agg(F.sum("m").alias("o"))
    centres = written(_central(many.join(shares, "s")), folder, "centres")
    centres = written(_common(many.join(centres, "key")), folder, "common")
    met = many.join(centres, "key")
    stars = met.filter((F.col("s") != F.col("c")) & _close("n", "nc")).select(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b"))
    apart = _apart(pairs.union(stars).distinct().select(F.col("a").alias("s"), F.col("b").alias("c")), found, f"{folder}/near")
    pairs = written(apart.filter("outside").select(F.col("s").alias("a"), F.col("c").alias("b")), folder, "pairs")
    found = written(found.union(_verified(pairs, candidates)).distinct(), folder, "links-1")
    around = written(_apart(met.select("c", "s").distinct(), found, folder), folder, "around")
    placed = written(_placed(around, candidates, folder), folder, "placed")
    found = written(found.union(_verified(written(_nearer(placed), folder, "nearer"), candidates)).distinct(), folder, "links-2")
    around = written(_apart(around.select("c", "s"), found, f"{folder}/again"), folder, "still-around")
    rest = written(_differing_alike(placed.drop("root", "outside").join(around, ["c", "s"])), folder, "rest")
    return written(found.union(_verified(rest, candidates)).distinct(), folder, "links-3")


def _nearest(sets: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are linked by operator 10's method: the largest of each, and the others of one with its largest."""
    first = sets.groupBy("fp").agg(F.max(F.struct("n", "s")).alias("x"))
    one = lambda fp, s, n: first.select(F.col("fp").alias(fp), F.col("x.s").alias(s), F.col("x.n").alias(n))
    same = sets.select("fp", "s", "n").join(one("fp", "c", "nc"), "fp").filter((F.col("s") != F.col("c")) & _close("n", "nc")).select(F.col("s").alias("a"), F.col("c").alias("b"))
    near = simhash_golay.links(first.select("fp"), folder).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = near.join(one("fa", "a", "na"), "fa").join(one("fb", "b", "nb"), "fb").filter(_close("na", "nb")).select("a", "b")
    both = same.union(near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _central(many: DataFrame) -> DataFrame:
    """The member of each bucket (key, s, n) that shares most, by ``o``: (key, o, c, nc)."""
    return many.groupBy("key").agg(F.max(F.struct("o", "s", "n")).alias("x")).select("key", F.col("x.o").alias("o"), F.col("x.s").alias("c"), F.col("x.n").alias("nc"))


def _common(met: DataFrame) -> DataFrame:
    """One centre for the buckets of a group, of ``met`` (key, s, o, c, nc): (key, c, nc).

    Each member names the one that shares most of all centres it meets, and a bucket takes what most of its members name. It need not
    be a member itself: the bound on shared differences holds for any set that all of the bucket are compared with.
    """
    named = met.groupBy("s").agg(F.max(F.struct("o", "c", "nc")).alias("x"))
    votes = met.select("key", "s").join(named, "s").groupBy("key", "x").agg(F.count("*").alias("votes"))
    return votes.groupBy("key").agg(F.max(F.struct("votes", "x")).alias("y")).select("key", F.col("y.x.c").alias("c"), F.col("y.x.nc").alias("nc"))


def _apart(around: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """``around`` (c, s) with the component of s, root, and whether the centre is in another one, outside."""
    comp = components(found, folder)
    root = lambda n: comp.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    each = around.join(root("s"), "s", "left").join(root("c"), "c", "left")
    return each.select("c", "s", F.coalesce("root_s", "s").alias("root"), (F.coalesce("root_s", "s") != F.coalesce("root_c", "c")).alias("outside"))


def _placed(around: DataFrame, candidates: DataFrame, folder: str) -> DataFrame:
    """The shingles x that sets around a centre differ in, with their place among those of the set from the rarest on; without those of one set only."""
    rows = around.join(around.filter("outside").select("c").distinct(), "c", "left_semi")
    own, middle = candidates.select("s", "shingles"), candidates.select(F.col("s").alias("c"), F.col("n").alias("nc"), F.col("shingles").alias("middle"))
    more = F.array_except("shingles", "middle")
    d = rows.join(own, "s").join(middle, "c").select("c", "s", "root", "outside", (F.col("nc") + F.size(more)).alias("u"), F.concat(more, F.array_except("middle", "shingles")).alias("d"))
    each = written(d.select("c", "s", "root", "outside", "u", F.size("d").alias("size"), F.explode("d").alias("x")), folder, "differences")
    often = each.groupBy("c", "x").agg(F.count("*").alias("often")).filter("often > 1")
    own = Window.partitionBy("c", "s")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "x"))
    return each.join(often, ["c", "x"]).withColumn("place", place)


def _prefix(t):
    """The place is among the rarest of which sets that share ``t`` must share one."""
    return F.col("place") <= F.col("size") - F.greatest(F.ceil(t - 1e-9), F.lit(1)) + 1


def _outer(placed: DataFrame) -> DataFrame:
    return placed.filter("outside").filter(_prefix(F.col("size") - (1 - SIMILAR) * F.col("u")))


def _nearer(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set outside and, for each of its rare differences, the set with the fewest others: in a group of copies most are linked so."""
    least = placed.groupBy("c", "x").agg(F.min(F.struct("outside", "size", "s")).alias("k")).select("c", "x", F.col("k.s").alias("y"))
    return _outer(placed).join(least, ["c", "x"]).filter("s != y").select(F.least("s", "y").alias("a"), F.greatest("s", "y").alias("b")).distinct()


def _differing_alike(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets around a centre that can be similar and aren't in one component: one of them is outside the centre's."""
    x = _outer(placed).select("c", "x", F.col("s").alias("a"), F.col("root").alias("ra"), F.col("place").alias("pa"), F.col("size").alias("na"), "u")
    y = placed.filter(_prefix(SIMILAR / (1 + SIMILAR) * F.col("size"))).select("c", "x", F.col("s").alias("b"), F.col("root").alias("rb"), F.col("place").alias("pb"), F.col("size").alias("nb"))
    t = (F.col("na") - (1 - SIMILAR) * F.col("u") + SIMILAR * F.col("nb")) / (1 + SIMILAR) - 1 - 1e-9  # the first shared one has so many behind it
    ok = (x.c == y.c) & (x.x == y.x) & (F.col("ra") != F.col("rb")) & (F.col("na") - F.col("pa") >= t) & (F.col("nb") - F.col("pb") >= t)
    return x.join(y, ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, own (the row's hash) and ``group``, which names its component."""
    prepare(df.sparkSession)
    folder = shared_dir(df.sparkSession)
    rows = df.select(column(df, doc_id).alias("doc_id"), row_hash(df).alias("own"), sets_udf(column(df, text)).alias("x"))
    rows = written(rows.select("doc_id", "own", "x.s", "x.n", "x.fp", "x.keys"), folder, "rows")
    sets = written(rows.dropDuplicates(["s"]).select("s", "n", "fp", "keys", "own"), folder, "sets")
    comp = components(links(sets, lambda owns: _candidates(df, text, owns), folder), folder).withColumnRenamed("node", "s")
    return rows.select("doc_id", "own", "s").join(comp, "s", "left").select("doc_id", "own", F.coalesce("root", "s").alias("group"))


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component, and its own columns."""
    return keep_least(df, grouped(df, doc_id, text), doc_id)
