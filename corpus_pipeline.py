"""From raw documents to training shards, in five stages of the subpackage ``llm``.

1. quality: documents that the production policy of the rule ledger rejects go (empty and null texts among them).
2. near_copies: of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more one
   document stays, that of the smallest id. Candidates come from operator 10's fingerprints and Golay keys, over five words; these miss
   most pairs near 0.8, so MinHash bands search for the others. All links are exact; components and the choice of the row are operator 10's.
3. decontamination: documents that contain an item of ``benchmark`` within the edit budget go.
4. mixing: documents are sampled with the calibrated probabilities of their source, language and learned topic.
5. shards: every document gets one of 40 shards of near equal bytes and a slot in it.

Stages 1 to 4 return the columns of the documents they are given. Every stage's result is written as Parquet to the shared
folder and read again, so a lost executor costs one stage at most.

Defined cases: rows without an id stay if their texts do (they come after rows with ids among copies); rows that repeat are copies,
of which one stays; ties between copies go to the smallest id, then to the row of least hash; empty tables give empty results with
the same columns; further columns of any name are carried along, and where ``shard`` or ``slot`` exist, the new ones are named otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import decontam_qgram, histogram_sharding, jaccard_copies, mixing_ipf, quality_rules
from vellumine.llm.common import shared_dir, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam_qgram.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing_ipf.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return histogram_sharding.shards(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("shards", shards)]

#: Shingle hashes, alignment and splitters aren't SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, folder, f"{k}-{name}")
    return docs
