"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one failure bit per
rule. A policy is a named, versioned mask over those bits: changing the policy, or asking what each rule
costs, reads the ledger's bits and never the texts again.

Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r``; a text's repeated words are the words inside
3-word windows that occur twice or more in it.

Defined cases: a null or empty text has no words, so it fails ``few_words``; repeated rows and repeated ids
are measured row by row; an empty table gives an empty ledger; ids may be null and are passed through; other
columns are kept by ``apply_policy`` and never clash, as helper columns take names that the input lacks.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, prepare, shared_dir, table, written

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Rule name -> SQL predicate over the measurements; a rule's bit is its place. Integer arithmetic only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_upper > 6 * (n_upper + n_lower)",
    "long_words": "word_chars > 40 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbol_heavy", "duplicate_lines", "shouting"),
    "v2-strict": tuple(RULES),
}
PRODUCTION_POLICY = "v2"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            cover = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    cover[i : i + 3] = b"\1\1\1"
            repeated = cover.count(1)
    lines = text.split("\n")
    full = [x for x in lines if x.strip(BLANKS)]
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LOWER)),
    )


_MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def _measure_batch(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts]
    columns = zip(*rows, strict=True) if rows else [[]] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


_measure_batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
measured = F.arrow_udf(_measure_batch, _MEASURED).asNondeterministic()  # evaluated once, never copied by the optimizer


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def failure_bits(measures: str) -> Column:
    """One bit per failed rule, from the fields of the struct column ``measures``."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(m, f"\0{MEASURES.index(m)}\0")
        for i, m in enumerate(MEASURES):
            rule = rule.replace(f"\0{i}\0", f"`{measures}`.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def with_ledger(df: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """``df`` with a struct of measurements and the failure bits; returns the names of those two columns too."""
    prepare(df.sparkSession)
    m, b = fresh(df, "measures"), fresh(df, "fail_bits")
    df = df.withColumn(m, measured(column(df, text)))
    return df.withColumn(b, failure_bits(m)), m, b


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger: ``doc_id``, every measurement and ``fail_bits``, one row per input row."""
    out, m, b = with_ledger(df.select(column(df, doc_id).alias("doc_id"), column(df, text).alias("text")))
    return out.select("doc_id", *[F.col(f"{m}.{x}").alias(x) for x in MEASURES], F.col(b).alias("fail_bits"))


def rejected(bits: Column, policy: str = PRODUCTION_POLICY) -> Column:
    """True where a rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def apply_policy(df: DataFrame, policy: str = PRODUCTION_POLICY, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with ``df``'s own columns."""
    out, _, b = with_ledger(df, text)
    return out.filter(~rejected(F.col(b), policy)).select(*[column(out, c) for c in df.columns])


def ablation(book: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay without it.

    Works on counts per distinct bit pattern, of which there are at most 2 ** len(RULES).
    """
    names, m = list(RULES), mask(POLICIES[policy])
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]
    patterns = book.groupBy((F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))).alias("bits")).agg(F.count("*").alias("n"))
    at = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    own = F.col("bits").bitwiseAND(F.col("r.bit"))
    return at.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(own != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when((own != 0) & (F.col("bits") == own), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") == own, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def sole_rule(bits: Column, policy: str = PRODUCTION_POLICY) -> Column:
    """The rule that alone rejects a document, which would stay without it; null where none or several reject it."""
    own, names = bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")), list(RULES)
    return F.coalesce(*[F.when(own == 1 << names.index(r), F.lit(r)) for r in POLICIES[policy]])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` under the production policy, read from the stored ledger with its measurements."""
    book = written(ledger(table(spark, sf_dir, "documents")), shared_dir(spark), "ledger")
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(mask(BASE_RULES)).cast("long")) != 0
    return book.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & ~rejected(bits)).alias("kept"), "fail_bits", sole_rule(bits).alias("sole_rule"))


ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines
       FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
       GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN dl ON w.doc_id = dl.doc_id),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_upper > 6 * (n_upper + n_lower) THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 31) = 0 AS kept, fail_bits,
       CASE fail_bits & 31 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbol_heavy' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'shouting' END AS sole_rule
FROM b
"""
