"""Shards of near equal size by histogram sort, with DataFrame operations only.

Rows are ordered by the key (bin, mix): ``bin`` is the leading bits of a hash of the text, so equal texts stand
together; ``mix`` is a hash of the id and the text, which splits a bin that many copies of one text fill. Where rows
repeat (equal id and text), ``mix`` also takes in a row number of the written table, so no two rows share a key. The 39
splitters between 40 shards are found by counting, never by sampling:

1. Count the exact bytes and rows of every bin, across all partitions.
2. Each splitter's target (k / 40 of all bytes) falls into one bin. While a splitter isn't within the tolerance of
   its target, probe the bin it falls into: count the bytes below each of 4096 finer boundaries of ``mix``, and
   keep the finer interval the target falls into. Five rounds exhaust the 64 bits of ``mix``.
3. Deal each row to its shard and exchange once, by (shard, leaf). A bin is cut by ``mix`` into as many leaves as its bytes
   ask for: a leaf has about ``LEAF_BYTES`` at most, and no more than a few ``LEAVES``-ths of all, so no task gets a shard or a
   frequent text as a whole. A row's slot is its rank in its leaf plus the exact number of rows in the shard's earlier leaves.

What the driver and broadcasts hold is bounded by the number of bins (2 ** ``MAX_BITS``), whatever the number of rows; the
table of leaves grows with the bytes over ``LEAF_BYTES`` and is joined.

Defined cases: a null text counts as empty (size 16); a null id is hashed like a value of its own; repeated rows are told
apart by their number, so they spread over shards like others; an empty table gives an empty result; columns of any
name are kept by ``shards`` and never clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import column, fresh, prepare, shared_dir, table, written

N_SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 1e-4  # of a shard's bytes; a splitter can't come closer than the size of a row allows
MIN_BITS, MAX_BITS = 10, 18  # of a bin's number
BIN_BYTES = 256 << 20
PART_BITS = 12  # of a round of probes
LEAF_BYTES = 256 << 20
LEAVES = 4096  # small tables are cut into about as many leaves
LAW = "bytes"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(doc_id.cast("string"), text, F.lit(1))


def _above(mix: str, bits: int) -> Column:
    """The leading ``bits`` bits of a hash, as a number from 0."""
    return F.shiftrightunsigned(F.col(mix), 64 - bits)


def _count() -> list[Column]:
    return [F.sum("size").cast("long").alias("b"), F.count("*").alias("n")]


def splitters(keys: DataFrame, filled: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The splitters as (bin, mix prefix below which a row lies left of it, as a number of 64 bits).

    ``keys`` has the columns bin, mix and size; ``filled`` the bytes and rows (b, n) of each bin.
    """
    count = _count()
    bins = {r["bin"]: (r["b"], r["n"]) for r in filled.collect()}  # at most 2 ** MAX_BITS rows
    total = sum(b for b, _ in bins.values())
    slack = tolerance * total / n_shards
    order, edge, below = sorted(bins), [], 0
    for b in order:
        edge.append(below)
        below += bins[b][0]
    found: dict[int, tuple[int, int]] = {}
    open_: dict[int, tuple[int, int, int, int]] = {}  # splitter -> bin, its prefix, the prefix's bits, bytes below the interval
    at = 0
    for k in range(1, n_shards):
        target = k * total / n_shards
        while at + 1 < len(order) and edge[at + 1] <= target:
            at += 1
        if not order or target - edge[at] <= slack:
            found[k] = (order[at] if order else 0, 0)
        else:
            open_[k] = (order[at], 0, 0, edge[at])
    while open_:
        known = max(p[2] for p in open_.values())
        step = min(PART_BITS, 64 - known)
        wanted = sorted({(b, p) for b, p, _, _ in open_.values()})
        probes = _literal(keys.sparkSession, [{"bin": b, "head": p} for b, p in wanted], "bin: long, head: long")  # at most one row a splitter
        head = _above("mix", known) if known else F.lit(0).cast("long")
        part = _above("mix", known + step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        rows = (
            keys.withColumn("head", head).withColumn("part", part)
            .join(F.broadcast(probes), ["bin", "head"])
            .groupBy("bin", "head", "part").agg(*count).collect()  # at most 4096 rows a splitter
        )
        finer: dict[tuple[int, int], list] = {}
        for r in rows:
            finer.setdefault((r["bin"], r["head"]), []).append((r["part"], r["b"], r["n"]))
        for k, (b, p, _, left) in list(open_.items()):
            target = k * total / n_shards
            parts, below = sorted(finer[b, p]), left
            for i, (x, size, n) in enumerate(parts):
                if below + size > target or i + 1 == len(parts):
                    break
                below += size
            prefix, width = p << step | x, known + step
            after = prefix + 1
            if target - below <= slack:
                found[k] = (b, prefix << (64 - width))
            elif below + size - target <= slack or n == 1 or width == 64:
                near = prefix if target - below <= below + size - target else after
                found[k] = (b, near << (64 - width))
            else:
                open_[k] = (b, prefix, width, below)
                continue
            del open_[k]
    cuts = [found[k] for k in range(1, n_shards)]
    return [max(cuts[: i + 1]) for i in range(len(cuts))]


def _literal(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from the driver, without Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def _signed(x: int) -> int:
    """An unsigned 64-bit number, moved so that comparison as a signed one keeps its order."""
    return min(x, (1 << 64) - 1) - (1 << 63)


def deal(rows: DataFrame, cuts: list[tuple[int, int]], parts: DataFrame) -> DataFrame:
    """``rows`` (with bin and mix) with their shard, part and place; no exchange."""
    keys = [F.struct(F.lit(b).cast("long").alias("bin"), F.lit(_signed(x)).cast("long").alias("place")) for b, x in cuts]
    place = F.col("mix").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    left = F.size(F.filter(F.array(*keys), lambda c: c <= F.struct(F.col("bin"), F.col("place")))) if keys else F.lit(0)
    rows = rows.join(F.broadcast(parts), "bin", "left").withColumn("place", place).withColumn("shard", left.cast("int"))
    return rows.withColumn("part", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(mix, 64 - bits)")).otherwise(F.lit(0).cast("long")))


def leaf_starts(dealt: DataFrame) -> DataFrame:
    """Rows of a shard before each of its leaves."""
    leaves = dealt.groupBy("shard", "bin", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("shard", "bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def slots(dealt: DataFrame, starts: DataFrame) -> DataFrame:
    """``dealt`` with each row's slot, after the one exchange of its rows."""
    rank = F.row_number().over(Window.partitionBy("shard", "bin", "part").orderBy("place"))
    ranked = dealt.withColumn("rank", rank).join(starts, ["shard", "bin", "part"])
    return ranked.withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))


def _distinct(keys: DataFrame) -> DataFrame | None:
    """``keys`` (hi, mix, nr) with a mix that no two rows share; None if it is so already."""
    if keys.groupBy("hi", "mix").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return None
    return keys.withColumn("mix", F.xxhash64("mix", "nr"))


def plan(keys: DataFrame, folder: str, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE) -> tuple[int, list[tuple[int, int]], DataFrame]:
    """The bits of a bin's number, the splitters, and the bits of ``mix`` that part each bin; for ``keys`` (hi, mix, size)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    bits = max(MIN_BITS, min(MAX_BITS, (total // BIN_BYTES).bit_length()))
    keys = keys.withColumn("bin", _above("hi", bits))
    filled = written(keys.groupBy("bin").agg(*_count()), folder, "bins")
    leaf = max(1, min(LEAF_BYTES, total // LEAVES))
    parts = filled.select("bin", F.greatest(F.ceil(F.log2(F.col("b") / leaf)), F.lit(0)).cast("int").alias("bits"))
    return bits, splitters(keys, filled, n_shards, tolerance), parts


def shards(df: DataFrame, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the columns shard and slot (named otherwise where ``df`` has such), its rows exchanged once.

    A shard's rows in slot order are its file; write with ``partitionBy`` on the shard column. Where rows repeat, they are
    first written with their numbers.
    """
    prepare(df.sparkSession)
    folder = shared_dir(df.sparkSession)
    hi, mix = _keys(column(df, doc_id), column(df, text))
    own = F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = df.select(own.alias("row"), hi.alias("hi"), mix.alias("mix"), size_of(column(df, text)).alias("size"))
    numbered = rows.withColumn("nr", F.monotonically_increasing_id())
    keys = written(numbered.drop("row"), folder, "keys")
    if _distinct(keys) is not None:
        rows = _distinct(written(numbered, folder, "rows"))
        keys = rows.drop("row")
    bits, cuts, parts = plan(keys, folder, n_shards)
    at = _above("hi", bits)
    starts = leaf_starts(deal(keys.withColumn("bin", at), cuts, parts))
    out = slots(deal(rows.withColumn("bin", at), cuts, parts), starts)
    names = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)]
    return out.select(*names, F.col("shard").alias(fresh(df, "shard")), F.col("slot").alias(fresh(df, "slot")))


def op4_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard and slot of each of all ``documents``, sizes near equal (law ``bytes``); texts are read once."""
    prepare(spark)
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    hi, mix = _keys(F.col("doc_id"), F.col("text"))
    keys = docs.select("doc_id", crc.alias("text_crc32"), hi.alias("hi"), mix.alias("mix"), size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("nr"))
    keys = written(keys, folder, "keys")
    own = _distinct(keys)
    keys = keys if own is None else own
    bits, cuts, parts = plan(keys, folder)
    dealt = deal(keys.withColumn("bin", _above("hi", bits)), cuts, parts)
    return slots(dealt, leaf_starts(dealt)).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
