"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of a text's word shingles.
To find all fingerprints that differ in at most ``MAX_BITS`` (2) bits without comparing all pairs, the 64 bits
are cut into three segments of 22, 21 and 21 bits, each padded to the 23 bits of the perfect binary Golay code:

* Pigeonhole: two errors touch at most two of the three segments, so one segment is free of errors.
* Fuzzy hash: the keys of a segment are the indices (12 bits) of the codewords to which the segment and its 23
  one-bit neighbours decode: 1 or 6 keys. Segments that differ in at most 2 bits have a neighbour in common, so
  they share a key.

So a fingerprint gets, for each segment, the keys (segment's exact bits, codeword index of the next segment): at
most 18, of about 33 bits each, and any two fingerprints within 2 bits share one. Fingerprints that share a key are
joined and verified by their exact distance. A key that more than ``BUCKET`` fingerprints share is not joined:
its members take the other exact way, where each fingerprint is sent to itself and its 64 one-bit neighbours, and
all that meet at one such centre (they differ in at most 2 bits, and all pairs within 2 bits meet) are linked to the
smallest of them: rows grow with the members, never with their square.

Components come from alternating large-star and small-star steps over the links, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero, which links like any other; equal texts have equal
fingerprints and so one component; rows with a null id belong to components but never name one, unless all ids
in it are null (then its name is null); repeated ids are treated row by row; an empty table gives an empty result.
``representatives`` keeps one row of each component: the one of the smallest id (null ids come last), among rows with
that id the one of least hash; all columns are kept and helper columns take names that the input lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, hex16, prepare, shared_dir, table, written

MAX_BITS = 2
BUCKET = 32
SEED = 42
BLOCK_BYTES = 1 << 20  # texts are hashed in blocks of about this size; a longer text is a block of its own
BLOCK_SHINGLES = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
# Bit k of a byte, moved to byte k of a 64-bit word: adding such words counts eight bits at once, up to 255 times.
_SPREAD = np.array([sum(((x >> k) & 1) << (8 * k) for k in range(8)) for x in range(256)], np.uint64)
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of the slices of the byte array ``data``; it is padded by 8 bytes at its end.

    Slices under 32 bytes are hashed together, lane by lane; longer ones, which are rare, one at a time.
    """
    out = np.full(len(start), np.uint64(SEED) + _P5 if SEED else _P5, np.uint64) + length.astype(np.uint64)
    words8 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    words4 = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    at, rest = start.copy(), length.copy()
    for _ in range(3):
        k = np.flatnonzero(rest >= 8)
        if not len(k):
            break
        lane = _rotl(words8[at[k]] * _P2, 31) * _P1
        out[k] = _rotl(out[k] ^ lane, 27) * _P1 + _P4
        at[k] += 8
        rest[k] -= 8
    k = np.flatnonzero(rest >= 4)
    out[k] = _rotl(out[k] ^ (words4[at[k]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[k] += 4
    rest[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(rest > 0)
        if not len(k):
            break
        out[k] = _rotl(out[k] ^ (data[at[k]].astype(np.uint64) * _P5), 11) * _P1
        at[k] += 1
        rest[k] -= 1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    long = np.flatnonzero(length >= 32)
    if len(long):
        raw = data.tobytes()
        cuts = zip(start[long].tolist(), (start[long] + length[long]).tolist(), strict=True)
        out[long] = np.fromiter(map(xxhash.xxh64_intdigest, (raw[a:b] for a, b in cuts), repeat(SEED)), np.uint64, len(long))
    return out


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes (``first`` holds their starts), how often each bit is set: (groups, 64)."""
    n = len(h)
    cuts = np.unique(np.concatenate([first, *[np.arange(a, b, 255) for a, b in zip(first, [*first[1:], n], strict=True)]]))
    group = np.searchsorted(cuts, first)
    counts = np.empty((len(first), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * k)) & np.uint64(255)], cuts)
        for j in range(8):
            counts[:, 8 * k + j] = np.add.reduceat(((sums >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64), group)
    return counts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower-case ASCII with single spaces, padded by 8 bytes; start and end of each word; words by text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = _LOWER[raw]
    blank = _BLANK[raw]
    after = np.empty_like(blank)
    after[0] = True
    after[1:] = blank[:-1]
    keep = ~(blank & after)  # of each run of blanks the first stays, as one space
    pos = np.flatnonzero(keep)
    data = raw[pos]
    space = blank[pos]
    data[space] = 32
    stop = np.flatnonzero(space)  # each word ends at a space
    start = np.zeros_like(stop)
    start[1:] = stop[:-1] + 1
    doc = np.searchsorted(ends, pos[start], side="right") if len(stop) else stop
    return np.concatenate([data, np.zeros(8, np.uint8)]), start, stop, np.bincount(doc, minlength=len(texts))


def _block(texts: list[bytes], size: int) -> np.ndarray:
    """Fingerprints of a block of texts."""
    data, start, stop, n_words = words(texts)
    if not len(stop):
        return np.zeros(len(texts), np.uint64)
    first_word = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = first_word[owner] + offset
    b = a + np.minimum(n_words[owner], size) - 1
    counts = np.zeros((len(texts), 64), np.int64)
    for i in range(0, len(a), BLOCK_SHINGLES):
        x, y, o = a[i : i + BLOCK_SHINGLES], b[i : i + BLOCK_SHINGLES], owner[i : i + BLOCK_SHINGLES]
        h = xxh64(data, start[x], stop[y] - start[x])
        first = np.concatenate([[0], np.flatnonzero(o[1:] != o[:-1]) + 1])
        counts[o[first]] += _bit_counts(h, first)
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: Iterator[str | None], size: int = 3) -> np.ndarray:
    """The fingerprints of whole texts, from shingles of ``size`` words (fewer words: the whole sequence)."""
    out, block, held = [np.zeros(0, np.uint64)], [], 0
    for t in texts:
        block.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            out.append(_block(block, size))
            block, held = [], 0
    if block:
        out.append(_block(block, size))
    return np.concatenate(out)


def _fingerprint_udf(size: int):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints((x.as_py() for x in texts), size).view(np.int64), pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.LongType()).asNondeterministic()


# The binary Golay code (23, 12): multiples of x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. A codeword's upper 12 bits are its index.
_G = 0b101011100011


def _remainder(x: int) -> int:
    for k in range(22, 10, -1):
        if x >> k & 1:
            x ^= _G << (k - 11)
    return x


_UNIT = np.array([_remainder(1 << k) for k in range(23)], np.int64)
_SYNDROME = [np.zeros(1 << 8, np.int64) for _ in range(3)]
for _byte in range(3):
    for _x in range(1 << 8):
        _SYNDROME[_byte][_x] = np.bitwise_xor.reduce([0, *[_UNIT[8 * _byte + k] for k in range(8) if _x >> k & 1 and 8 * _byte + k < 23]])
_ERROR = np.zeros(1 << 11, np.int64)  # by syndrome, the one pattern of at most 3 errors
for _i in range(23):
    _ERROR[_UNIT[_i]] = 1 << _i
    for _j in range(_i):
        _ERROR[_UNIT[_i] ^ _UNIT[_j]] = 1 << _i | 1 << _j
        for _k in range(_j):
            _ERROR[_UNIT[_i] ^ _UNIT[_j] ^ _UNIT[_k]] = 1 << _i | 1 << _j | 1 << _k
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices of the codewords to which each 23-bit value and its 23 neighbours decode: (n, 24), with repeats."""
    s = _SYNDROME[0][v & 255] ^ _SYNDROME[1][v >> 8 & 255] ^ _SYNDROME[2][v >> 16]
    s = np.concatenate([s[:, None], s[:, None] ^ _UNIT], axis=1)
    near = np.concatenate([v[:, None], v[:, None] ^ (1 << np.arange(23))], axis=1)
    return (near ^ _ERROR[s]) >> 11


def golay_keys(f: np.ndarray) -> list[np.ndarray]:
    """The distinct keys of each fingerprint."""
    seg = [((f >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in SEGMENTS]
    keys = [np.sort((k << 34) | (seg[k][:, None] << 12) | codewords(seg[(k + 1) % 3]), axis=1) for k in range(3)]
    return [np.concatenate([r[np.concatenate([[True], r[1:] != r[:-1]])] for r in rows]) for rows in zip(*keys, strict=True)]


def _keys_batch(prints: pa.Array) -> pa.Array:
    keys = golay_keys(np.asarray(prints.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))
    ends = np.cumsum([0, *map(len, keys)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64()))


_keys_batch.__annotations__ = {"prints": pa.Array, "return": pa.Array}
golay_keys_udf = F.arrow_udf(_keys_batch, T.ArrayType(T.LongType())).asNondeterministic()


def links(prints: DataFrame, folder: str) -> DataFrame:
    """All links (a, b) that join fingerprints within ``MAX_BITS`` bits; ``prints`` has distinct ``fp``.

    Pairs from small buckets are all of them; from a large bucket there are enough to connect what is linked.
    """
    keys = written(prints.select("fp", F.explode(golay_keys_udf("fp")).alias("key")), folder, "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keys.join(shared, "key").select("key", "fp", "n"), folder, "members")
    few = members.filter(F.col("n") <= BUCKET)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    many = members.filter(F.col("n") > BUCKET).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(64)])
    centres = many.select("fp", F.explode(F.transform(near, lambda e: F.col("fp").bitwiseXOR(e))).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("centre", "a")
    stars = centres.join(least, "centre").filter(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return written(pairs.union(stars).distinct(), folder, "links")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the least node; roots included.

    Alternates large-star and small-star steps until the links are stars; each round is written.
    """
    stars, before, k = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None, 0
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, folder, f"large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = written(small.distinct(), folder, f"small-{k}")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        before, k = now, k + 1


def _classes(df: DataFrame, doc_id: str, text: str, size: int, carry: dict[str, Column]) -> DataFrame:
    """doc_id, fp, component_id, ``group`` (names the component whatever its ids) and the carried columns, row by row."""
    spark = df.sparkSession
    prepare(spark)
    folder = shared_dir(spark)
    narrow = df.select(column(df, doc_id).alias("doc_id"), _fingerprint_udf(size)(column(df, text)).alias("fp"), *[c.alias(k) for k, c in carry.items()])
    prints = written(narrow, folder, "prints")
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")), folder, "each")
    comp = components(links(each.select("fp"), folder), folder)
    named = each.join(comp, each.fp == comp.node).select("fp", "lo", "root")
    least = named.groupBy("root").agg(F.min("lo").alias("c"))
    linked = named.join(least, "root").select("fp", "root", "c")
    names = each.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("c", "lo").alias("component_id"))
    return prints.join(written(names, folder, "names"), "fp").select("doc_id", "fp", "component_id", "group", *carry)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (the fingerprint as a long) and ``component_id``."""
    return _classes(df, doc_id, text, size, {}).select("doc_id", "fp", "component_id")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[column(df, f.name) for f in df.schema if "map<" not in f.dataType.simpleString()])


def keep_least(df: DataFrame, grouped: DataFrame, doc_id: str) -> DataFrame:
    """``df`` with one row of each ``group`` of ``grouped``, which has doc_id, ``row_hash`` as own, and group, row by row.

    Which rows stay is settled on the narrow table; of ``df`` only rows that occur more than once are exchanged to keep one.
    """
    each = grouped.groupBy("group", "doc_id", "own").agg(F.count("*").alias("n"))
    kept = each.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own", "n")).alias("k"))
    i, h, n = fresh(df, "kept_id"), fresh(df, "kept_hash"), fresh(df, "kept_times")
    kept = written(kept.select(F.coalesce("k.doc_id", F.lit(0)).alias(i), F.col("k.own").alias(h), F.col("k.n").alias(n)), shared_dir(df.sparkSession), "kept")
    rows = df.withColumn(i, F.coalesce(column(df, doc_id), F.lit(0))).withColumn(h, row_hash(df)).join(kept, [i, h])
    if not kept.filter(F.col(n) > 1).isEmpty():
        rows = rows.filter(F.col(n) == 1).union(rows.filter(F.col(n) > 1).dropDuplicates([i, h]))
    return rows.select(*[column(df, c) for c in df.columns])


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``df`` with one row of each component, and its own columns."""
    return keep_least(df, _classes(df, doc_id, text, size, {"own": row_hash(df)}), doc_id)


def op10_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """The component of each of all ``documents``."""
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
