"""Acquisition: search items and details to Markdown, registry rows and errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import patterns as P
from vellumine.functions import text as X
from vellumine.sources import html as H
from vellumine.sources import registry as Reg


def select(items: DataFrame, keyword: str = "", scope: str = "title", types: tuple[str, ...] = P.DOCUMENT_TYPES, statuses: tuple[str, ...] = P.STATUSES, max_docs: int | None = None) -> DataFrame:
    """The search results to fetch: allowed, with the keyword in the title (``scope`` "all" leaves that to the service), each once."""
    found = Reg.dedupe_results(Reg.search_results(Reg.pushed(items, types, statuses, keyword, scope == "title"), types))
    return found if max_docs is None else found.orderBy("document_id").limit(max_docs)


def documents(results: DataFrame, details: DataFrame, now: str) -> DataFrame:
    """Results with their detail items (``Reg.ITEM``) as documents: metadata, content blocks, Markdown and its hash.

    Rows without content have ``error`` set and no Markdown.
    """
    body = F.col("documentContent.content")
    own = details.select(F.trim(X.text("id")).alias("document_id"), Reg.detail_map().alias("detail"), F.concat(F.lit("<div id=toanvan>"), X.text(body), F.lit("</div>")).alias("html"), X.text(body).alias("raw"))
    rows = H.parsed_pages(results.join(own, "document_id", "left"), legal_only=False)
    bad = X.text("raw") == ""
    meta = F.coalesce(F.map_zip_with("metadata", "detail", lambda k, a, b: X.first_of(b, a)), F.col("metadata"))
    rows = rows.withColumn("metadata", meta).withColumn("error", F.when(bad, F.lit("no content")))
    text = H.document_markdown("page.blocks", "source_url", "document_type", "status", "title")
    rows = rows.withColumn("full", text).withColumn("name", X.slug("title", F.col("metadata")["so_ky_hieu"]))
    given = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(
        "document_id", "source_url", "title", "document_type", "status", "metadata", F.col("page.blocks").alias("content_tree"), F.col("page.text").alias("content_text"),
        given(F.col("full")).alias("markdown"), given(F.concat("name", F.lit(".md"))).alias("markdown_path"), F.lit(now).alias("crawled_at"), "error",
        given(F.sha2("full", 256)).alias("content_sha256"), given(F.octet_length("full")).cast("bigint").alias("content_bytes"),
    )


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The registry at ``path``, or an empty one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], Reg.SCHEMA + ", seq bigint")


def registered(registry: DataFrame, docs: DataFrame, seq: int) -> DataFrame:
    """The registry (``Reg.SCHEMA`` and seq) after these documents and errors."""
    m = F.col("metadata")
    known = {c: F.col(c) for c in docs.columns if c in Reg.COLUMNS} | {k: X.first_of(m[k], m[a]) for k, a in Reg.ALIASES.items()}
    known |= {"crawl_status": F.lit("crawled"), "metadata_json": F.to_json(F.struct("metadata")), "seq": F.lit(seq).cast("bigint"), "updated_at": X.text(m["updated_at"])}
    good = docs.filter("error IS NULL").select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in registry.dtypes])
    failed = docs.filter("error IS NOT NULL").select("document_id", "source_url", "title", "document_type", "status", "error", "crawled_at", F.lit(seq).cast("bigint").alias("seq"))
    return Reg.error_upsert(Reg.upsert(registry, good), failed)
