"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are normalised: lower case, letters and digits only, anything else one space. An item of m
characters is contained in a document if some region of it is within e = ``RATE`` * m edits (insertions, deletions,
substitutions; whole items count, parts of them don't). By the q-gram lemma such a region shares t = m + 1 - q - q * e of
the item's q-grams with it, all on e + 1 neighbouring diagonals (position in the document minus position in the item).
q is ``Q``, or less for items so short that t would fall below 1: the largest q that leaves t >= 1.

1. Every position of every text is hashed (q characters) and looked up in the items' q-grams, for each q in use.
2. Hits count only where enough of them stand within an item's length; items are grouped in classes of similar length,
   each with its longest region and least t, so nothing that meets the lemma is lost.
3. These hits are counted per item and diagonal band; bands are 2 (e + 1) diagonals wide and overlap by half, so each
   window of e + 1 diagonals lies in one. Bands with t hits or more are retained.
4. Retained regions are verified by banded alignment, many at once; no region spans two texts.

Items that allow no edit (m under 1 / ``RATE``) are one q-gram of all their characters, compared character by
character; they count where they stand as whole words.

Items are the stated query set: they are broadcast in blocks of at most ``BLOCK_CHARS`` characters (or one longer
item), one pass over the documents for each block; with several blocks each pass writes what it finds, by a digest of the text, so
that a worker holds one block's index and builds it once.

Defined cases: null and empty texts and items contain and match nothing; repeated documents are scanned row by row and
repeated items reported once per distinct id; null ids of documents pass through, items with a null id are ignored; an
empty table on either side gives no matches; all columns are kept and names of new ones never clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, prepare, shared_dir, table

Q = 8
RATE = 0.08
BLOCK_CHARS = 2_000_000  # of items that are broadcast together
SCAN_CHARS = 1 << 19  # of texts that are scanned together; a longer text is a block of its own
CLASS_STEP = 1.25
PAIRS = 1 << 21  # q-gram hits that are expanded at a time
ALIGN = 256  # regions that are aligned together
_FENCE = 0x110000  # stands between texts; no character
_BITS = 22


@lru_cache(1)
def _fold() -> np.ndarray:
    """Of each character of the basic plane: its lower case, or a space if it is neither letter nor digit."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalnum() else 32 for c in range(0x10000)], np.uint32)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised characters of all texts with a fence after each, their offsets and their texts' numbers."""
    raw = np.frombuffer("￿".join(texts).encode("utf-32-le", "surrogatepass") + b"\xff\xff\x00\x00", "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.where(raw < 0x10000, _fold()[np.minimum(raw, 0xFFFF)], raw)
    codes[ends - 1] = _FENCE
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (codes[:-1] == _FENCE)))
    keep[0] = not blank[0]
    keep[:-1] &= ~(blank[:-1] & (codes[1:] == _FENCE))
    pos = np.flatnonzero(keep)
    doc = np.searchsorted(ends, pos, side="right")
    return codes[pos], pos - np.concatenate([[0], ends[:-1]])[doc], doc


def _hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each position on, by doubling."""
    base, h, width = np.uint64(0xBF58476D1CE4E5B9), codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), 1
    out, done = None, 0
    while q:
        if q & 1:
            out = _joined(out, h, done, width, base)
            done += width
        q >>= 1
        if q:
            h = h[: max(0, len(h) - width)] * _power(base, width) + h[width:]
            width *= 2
    return out ^ (out >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _joined(out: np.ndarray | None, h: np.ndarray, done: int, width: int, base: np.uint64) -> np.ndarray:
    """Hashes of done + width characters from those of ``done`` and of ``width`` characters."""
    if out is None:
        return h
    n = max(0, len(h) - done)
    return out[:n] * _power(base, width) + h[done:]


def _start(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


class Grams:
    """The q-grams of some items of an index, all for one q."""

    def __init__(self, q: int, items: np.ndarray, codes: list[np.ndarray], m: np.ndarray, e: np.ndarray) -> None:
        self.q, self.items, self.m, self.e = q, items, m[items], e[items]
        self.t = self.m + 1 - q - q * self.e
        grams = [_hashes(codes[i], q) for i in items]
        all_ = np.concatenate(grams)
        order = np.argsort(all_, kind="stable")
        self.grams, self.first, self.n = np.unique(all_[order], return_index=True, return_counts=True)
        lengths = np.array([len(g) for g in grams])
        self.owner = np.repeat(np.arange(len(grams)), lengths)[order]
        self.place = (np.arange(len(all_)) - np.repeat(_start(lengths), lengths))[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.classes: list[tuple[int, int]] = []  # longest region and least t of items of similar length
        by = np.argsort(self.m, kind="stable")
        start = 0
        for k in range(1, len(by) + 1):
            if k == len(by) or self.m[by[k]] > CLASS_STEP * self.m[by[start]]:
                some = by[start:k]
                self.classes.append((int((self.m[some] + self.e[some]).max()), int(self.t[some].min())))
                start = k
        self.width = int(self.m.max())

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram an item has, and the q-gram's number."""
        h = _hashes(codes, self.q)
        at = np.flatnonzero(self.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[g] == h[at]
        return at[same], g[same]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``look_up`` where enough hits stand together."""
        at, g = self.look_up(codes)
        alive = np.zeros(len(at) + 1, np.int64)
        for region, t in self.classes:
            if len(at) >= t:
                k = np.flatnonzero(at[t - 1 :] - at[: len(at) - t + 1] <= region - self.q)
                np.add.at(alive, k, 1)
                np.add.at(alive, k + t, -1)
        live = np.cumsum(alive[:-1]) > 0
        return at[live], g[live]

    def pairs(self, at: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position, item (its place in ``items``) and position in the item of all hits, some ``PAIRS`` at a time."""
        ends = np.cumsum(self.n[g])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS)), [len(g)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = self.n[g[lo:hi]]
            k = np.repeat(self.first[g[lo:hi]] - _start(n), n) + np.arange(n.sum())
            yield np.repeat(at[lo:hi], n), self.owner[k], self.place[k]

    def regions(self, codes: np.ndarray) -> np.ndarray:
        """(item's number in the index, first diagonal) of the bands with enough hits: (n, 2)."""
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        for at, item, place in self.pairs(*self.hits(codes)):
            band = (at - place + self.width) // (self.e[item] + 1)  # not negative
            keys = np.concatenate([item << 40 | band, item << 40 | (band - 1)])
            counted.append(np.unique(keys[(keys & (1 << 40) - 1) < (1 << 39)], return_counts=True))
        if not counted:
            return np.zeros((0, 2), np.int64)
        key, where = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        total = np.bincount(where, np.concatenate([c[1] for c in counted]))
        key = key[total >= self.t[key >> 40]]
        item, band = key >> 40, key & ((1 << 40) - 1)
        return np.stack([self.items[item], band * (self.e[item] + 1) - self.width], axis=1)

    def exact(self, codes: np.ndarray, all_: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For items of q characters: (item's number in the index, position) of each whole-word occurrence."""
        whole = np.stack([all_[i] for i in self.items])
        inner = np.concatenate([[_FENCE], codes])
        for at, item, _ in self.pairs(*self.look_up(codes)):
            words = ((inner[at] == 32) | (inner[at] == _FENCE)) & ((codes[at + self.q] == 32) | (codes[at + self.q] == _FENCE))
            at, item = at[words], item[words]
            same = (codes[at[:, None] + np.arange(self.q)] == whole[item]).all(axis=1)
            yield self.items[item[same]], at[same]


class Index:
    """Items (id, text) ready to be searched for."""

    def __init__(self, items: Iterable[tuple[int, str | None]]) -> None:
        found = {}
        for i, t in items:
            codes = normalised([t or ""])[0][:-1]
            if i is not None and len(codes):
                found.setdefault((i, codes.tobytes()), codes)
        self.ids = np.array([k[0] for k in found], np.int64)
        self.codes = list(found.values())
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.e = (self.m * RATE).astype(np.int64)
        q = np.where(self.e > 0, np.minimum(Q, self.m // (self.e + 1)), self.m)
        each = lambda some: [Grams(int(k), np.flatnonzero(some & (q == k)), self.codes, self.m, self.e) for k in np.unique(q[some])]
        self.near, self.exact = each(self.e > 0), each(self.e == 0)

    def align(self, codes: np.ndarray, regions: np.ndarray, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The least edits of each region's item, and the position after (backwards: of) its last (first) character.

        A band covers the region's 2 (e + 1) diagonals and e more on either side. Fences can't be crossed.
        """
        item, d = regions[:, 0], regions[:, 1]
        e, m = self.e[item], self.m[item]
        width = int((4 * e + 2).max())
        kind = np.int32 if width * width < 1 << 30 else np.int64
        far = kind(1 << 20)
        rows = np.full((len(item), int(m.max())), _FENCE + 1, np.uint32)
        for r, i in enumerate(item):
            rows[r, : m[r]] = self.codes[i][::-1] if backwards else self.codes[i]
        k = np.arange(width, dtype=kind)
        outside = k[None, :] >= (4 * e + 2)[:, None]
        cost = np.where(outside, far, 0).astype(kind)
        best, end = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        begin = (d + m + 3 * e + 1)[:, None] - k[None, :] if backwards else (d - e)[:, None] + k[None, :]
        for j in range(int(m.max())):
            at = begin - j if backwards else begin + j
            inside = (at >= 0) & (at < len(codes))
            text = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], _FENCE)
            wall = text == _FENCE
            new = cost + (text != rows[:, j : j + 1])
            way = k  # the price of characters of the text beside the item's, up to each place
            if wall.any():
                new[wall] = far
                way = k + np.cumsum(wall, axis=1, dtype=kind) * kind(width)  # more than any budget
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.minimum.accumulate(new - way, axis=1) + way
            new[outside] = far
            cost = np.where((j < m)[:, None], new, cost)
            for r in np.flatnonzero(j + 1 == m):
                x = int(np.argmin(cost[r]))
                best[r] = cost[r, x]
                end[r] = at[r, x] if backwards else at[r, x] + 1
        return best, end

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its (item id, edits, start, end), one per item id, by id; offsets in code points."""
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        codes, offset, doc = normalised(texts)
        for grams in self.exact:
            for item, at in grams.exact(codes, self.codes):
                _, first = np.unique(np.stack([doc[at], self.ids[item]]), axis=1, return_index=True)
                for i, p in zip(item[first].tolist(), at[first].tolist(), strict=True):
                    self._keep(out[int(doc[p])], (int(self.ids[i]), 0, int(offset[p]), int(offset[p + grams.q - 1]) + 1))
        regions = np.concatenate([np.zeros((0, 2), np.int64), *[grams.regions(codes) for grams in self.near]])
        regions = regions[np.argsort(self.m[regions[:, 0]], kind="stable")]
        for i in range(0, len(regions), ALIGN):
            some = regions[i : i + ALIGN]
            edits, end = self.align(codes, some)
            good = edits <= self.e[some[:, 0]]
            if not good.any():
                continue
            some, edits, end = some[good], edits[good], end[good]
            _, begin = self.align(codes, some, backwards=True)
            for (item, _), d, a, b in zip(some.tolist(), edits.tolist(), begin.tolist(), end.tolist(), strict=True):
                a, b = max(0, min(a, len(codes) - 1)), max(1, min(b, len(codes)))
                owner = int(doc[b - 1])
                first = int(offset[a]) if doc[a] == owner else 0
                self._keep(out[owner], (int(self.ids[item]), int(d), first, int(offset[b - 1]) + 1))
        return [[x[k] for k in sorted(x)] for x in out]

    @staticmethod
    def _keep(out: dict[int, tuple[int, int, int, int]], new: tuple[int, int, int, int]) -> None:
        """The match of fewest edits, then the first, is an item's."""
        old = out.get(new[0])
        if old is None or new[1:] < old[1:]:
            out[new[0]] = new


_CACHE: dict[str, Index] = {}
_CACHED = 2  # indexes that a worker keeps; a pass over the documents needs one


def _index(name: str, items) -> Index:
    """The index of a broadcast block of items, built in each worker where it is first used."""
    if name not in _CACHE:
        while len(_CACHE) >= _CACHED:
            del _CACHE[next(iter(_CACHE))]
        _CACHE[name] = Index(items.value)
    return _CACHE[name]


def find_all(texts: Iterable[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """``Index.find`` over blocks of texts."""
    out, block, held = [], [], 0
    for t in texts:
        block.append(t or "")
        held += len(block[-1])
        if held >= SCAN_CHARS:
            out += index.find(block)
            block, held = [], 0
    return out + (index.find(block) if block else [])


MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _matcher(name: str, items):
    inner = pa.list_(pa.struct([(f.name, pa.int64()) for f in MATCH]))

    def run(texts: pa.Array) -> pa.Array:
        found = find_all((t.as_py() for t in texts), _index(name, items))
        return pa.array([[dict(zip(MATCH.names, x, strict=True)) for x in r] for r in found], inner)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def with_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with an array of matches (item_id, edits, start, end); returns that column's name too."""
    spark = docs.sparkSession
    prepare(spark)
    items = items.select(column(items, item_id).cast("long").alias("id"), column(items, item_text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    name = fresh(docs, "matches")

    def matcher(k: int):
        some = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "t") if blocks > 1 else items.orderBy("id", "t")
        shared = spark.sparkContext.broadcast([(r["id"], r["t"]) for r in some.collect()])  # about BLOCK_CHARS characters
        return F.arrow_udf(_matcher(uuid.uuid4().hex, shared), T.ArrayType(MATCH)).asNondeterministic(), shared

    if blocks == 1:
        return docs.withColumn(name, matcher(0)[0](column(docs, text))), name
    folder, digest = shared_dir(spark), fresh(docs, "text_digest")
    for k in range(blocks):
        found, shared = matcher(k)
        some = docs.select(column(docs, text).alias("t")).filter("t <> ''").select("t", found("t").alias("m")).filter(F.size("m") > 0)
        some = some.select(F.sha2(F.col("t").cast("binary"), 256).alias("d"), F.explode("m").alias("m"))
        some.distinct().write.mode("overwrite").parquet(f"{folder}/matches/block={k}")
        shared.unpersist()
    each = spark.read.parquet(f"{folder}/matches").groupBy("d").agg(F.array_sort(F.collect_list("m")).alias("m"))  # of one text; copies count once
    each = each.select(F.col("d").alias(digest), F.col("m").alias(name))
    out = docs.withColumn(digest, F.sha2(column(docs, text).cast("binary"), 256)).join(each, digest, "left")
    return out.select(*[column(out, c) for c in docs.columns], F.coalesce(F.col(name), F.array().cast(T.ArrayType(MATCH))).alias(name)), name


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no item, with ``docs``'s own columns."""
    out, m = with_matches(docs, items, text)
    return out.filter(F.size(m) == 0).select(*[column(out, c) for c in docs.columns])


def op7_decontam_qgram(spark, sf_dir: str) -> DataFrame:
    """For each of all ``documents`` the items of ``benchmark`` that it contains."""
    out, m = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size(m) > 0).alias("contaminated"), F.transform(m, lambda x: x.item_id).alias("item_ids"), F.size(m).cast("long").alias("n_items"))
