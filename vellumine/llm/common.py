"""Helpers shared by the operators: the shared folder, written tables and Arrow batch limits."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Bounds of one Arrow batch, so that a Python worker never holds more than this plus its largest row.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none gets a temporary folder of its machine; a cluster must name one.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vellumine-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at files that outlive any executor."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns never clash with helper columns."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def column(df: DataFrame, name: str) -> Column:
    """``df``'s column, quoted: names may hold dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def hex16(c: Column) -> Column:
    """A 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
