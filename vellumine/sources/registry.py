"""The registry of documents: API pages to rows, upserts, metadata by precedence, and lookups by file.

A registry is a DataFrame with one row per document; ``seq`` orders the writes. A column's own value wins over the nested
metadata in ``metadata_json``, and empty counts as missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import patterns as P
from vellumine.functions import text as X

COLUMNS = (
    "document_id", "source_url", "title", "document_type", "status", "doc_number", "issuing_agency", "issue_date", "effective_date", "expiry_date", "crawled_at", "updated_at", "json_path",
    "markdown_path", "content_sha256", "content_bytes", "crawl_status", "error", "metadata_json",
)
SCHEMA = ", ".join(f"{c} {'bigint' if c == 'content_bytes' else 'string'}" for c in COLUMNS)
KEPT_ON_ERROR = ("json_path", "markdown_path", "content_sha256", "content_bytes")
ITEM = (
    "id string, title string, docType struct<name string>, effStatus struct<name string>, docNum string, agencyName string, issueDate string, effFrom string, effTo string, "
    "signerName string, signer string, updatedDate string, documentContent struct<content string>"
)
#: Other names under which a value may be nested.
ALIASES = {"doc_number": "so_ky_hieu", "issuing_agency": "co_quan_ban_hanh", "issue_date": "ngay_ban_hanh", "effective_date": "ngay_hieu_luc", "expiry_date": "ngay_het_hieu_luc"}


def api_pages(fetch: Callable[[int], dict], size: int = 100, max_docs: int | None = None) -> Iterator[dict]:
    """Pages of a paged search until its total is reached; ``fetch`` does the request for a page number."""
    page, got = 1, 0
    while True:
        body = fetch(page)
        body = body.get("data") or body
        items = body.get("items") or []
        yield {"items": items, "total": body.get("total") or 0}
        got += len(items)
        if not items or page * size >= (body.get("total") or 0) or (max_docs is not None and got >= max_docs):
            return
        page += 1


def write_pages(pages: Iterator[dict], spark: SparkSession, path: str) -> None:
    """Pages as JSON lines, for ``spark.read.json``; one page at a time is held."""
    for k, page in enumerate(pages):
        spark.createDataFrame([(json.dumps(page, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append" if k else "overwrite").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"items array<struct<{ITEM}>>, total bigint").json(path)


def category_ids(found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Ids of categories by name: those found (name, id), else the constants."""
    rows = found.sparkSession.createDataFrame(list(wanted.items()), "name string, fallback string")
    return rows.join(found.groupBy("name").agg(F.max("id").alias("id")), "name", "left").select("name", X.first_of("id", "fallback").alias("id"))


def pushed(items: DataFrame, types: tuple[str, ...] = P.DOCUMENT_TYPES, statuses: tuple[str, ...] = (), words: str = "", title_only: bool = True) -> DataFrame:
    """The predicates that a search service would apply: type, status and words of the title."""
    out = items.filter(F.col("docType.name").isin(*types)) if types else items
    out = out.filter(F.col("effStatus.name").isin(*statuses)) if statuses else out
    return out.filter(X.contains_keyword("title", F.lit(words))) if words and title_only else out


def summary(i: Column | None = None) -> dict[str, Column]:
    at = (lambda n: i[n]) if i is not None else F.col
    return {
        "so_ky_hieu": X.normalize_space(at("docNum")), "co_quan_ban_hanh": X.normalize_space(at("agencyName")), "ngay_ban_hanh": X.api_date(at("issueDate")), "ngay_hieu_luc": X.api_date(at("effFrom")),
        "ngay_het_hieu_luc": X.api_date(at("effTo")),
    }


def as_map(values: dict[str, Column]) -> Column:
    """The values that aren't empty, as a map."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v != "")


def search_results(items: DataFrame, types: tuple[str, ...] = P.DOCUMENT_TYPES) -> DataFrame:
    """Search results of API items: id, title and an allowed type are needed; one row per id."""
    rows = items.select(
        F.trim(X.text("id")).alias("document_id"), X.normalize_space("title").alias("title"), X.normalize_space(F.col("docType.name")).alias("document_type"),
        X.normalize_space(F.col("effStatus.name")).alias("status"), as_map(summary()).alias("metadata"),
    )
    rows = rows.filter((F.col("document_id") != "") & (F.col("title") != "") & F.col("document_type").isin(*types))
    return first_of_equals(rows.withColumn("source_url", X.public_url("document_id", "title")), "document_id")


def first_of_equals(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the least in the order of its columns (maps by their JSON), so that it doesn't depend on chance."""
    others = [c for c in rows.columns if c != key]
    order = F.struct(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes if c != key])
    least = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("least"))
    return least.select(*[F.col(key) if c == key else F.col(f"least.{c}").alias(c) for c in rows.columns])


def detail_map() -> Column:
    """A detail item's metadata."""
    more = {"nguoi_ky": X.normalize_space(X.first_of("signerName", "signer")), "document_id": X.normalize_space("id"), "updated_at": X.api_date("updatedDate"), "document_type": X.normalize_space(F.col("docType.name")), "status": X.normalize_space(F.col("effStatus.name"))}
    return as_map(summary() | more)


def allowed(rows: DataFrame, types: tuple[str, ...] = P.DOCUMENT_TYPES, statuses: tuple[str, ...] = P.STATUSES) -> DataFrame:
    return rows.filter(F.col("document_type").isin(*types) & F.col("status").isin(*statuses))


def dedupe_results(rows: DataFrame, order: str = "document_id") -> DataFrame:
    """Results once by number and title, letter case aside; the first in order stays."""
    key = X.first_of(X.dedupe_key(F.col("metadata")["so_ky_hieu"], "title"), "source_url")
    at = Window.partitionBy("dedupe_key").orderBy(order)
    return rows.withColumn("dedupe_key", key).withColumn("rn", F.row_number().over(at)).filter("rn = 1").drop("rn", "dedupe_key")


def document_id() -> Column:
    return X.first_of("document_id", X.id_from_url("source_url"), F.sha2(X.text("source_url"), 256))


def upsert(registry: DataFrame, batch: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The registry after a batch of writes: the last write of each document wins whole, but for ``keep``, whose last value that isn't null stays.

    Both sides have ``seq``; the larger is the later.
    """
    every = registry.unionByName(batch).withColumn("document_id", document_id())
    others = [c for c in registry.columns if c not in ("document_id", *keep)]
    last = F.max_by(F.struct(*others), "seq").alias("last")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in keep]
    rows = every.groupBy("document_id").agg(last, *kept)
    return rows.select(*[F.col(c) if c in ("document_id", *keep) else F.col(f"last.{c}").alias(c) for c in registry.columns])


def error_upsert(registry: DataFrame, errors: DataFrame) -> DataFrame:
    """The registry after failed fetches (document_id, source_url, title, document_type, status, error, crawled_at, seq).

    The status becomes ``error``; where the content was stored, and its hash, stay.
    """
    have = set(errors.columns)
    full = errors.select(*[F.lit("error").alias(c) if c == "crawl_status" else F.col(c) if c in have else F.lit(None).cast(dict(registry.dtypes)[c]).alias(c) for c in registry.columns])
    return upsert(registry, full, KEPT_ON_ERROR)


def nested(key: str, c: X.Text = "metadata_json") -> Column:
    return F.get_json_object(X.col(c), f"$.metadata.{key}")


def metadata(registry: DataFrame) -> DataFrame:
    """Registry rows with every document column filled from the nested metadata where it is empty."""
    have = set(registry.columns)
    own = {k: [k] * (k in have) + [nested(k)] + [nested(a) for a in [ALIASES.get(k)] if a] for k in P.DOCUMENT_KEYS}
    rest = [c for c in registry.columns if c not in P.DOCUMENT_KEYS]
    return registry.select(*[X.first_of(*v).alias(k) for k, v in own.items()], *rest)


def crawled(registry: DataFrame) -> DataFrame:
    return registry.filter("crawl_status = 'crawled'")


def in_order(registry: DataFrame) -> DataFrame:
    """By date of issue as a date, then by id."""
    return registry.orderBy(X.day("issue_date").asc_nulls_first(), "document_id")


def path_key(c: X.Text) -> Column:
    return F.lower(F.replace(X.text(c), F.lit("\\"), F.lit("/")))


def lookup(files: DataFrame, registry: DataFrame, root: str = "") -> DataFrame:
    """``files`` (path) with their registry row in ``registry``: by full path, by path below ``root``, else by name.

    Of rows with one key the last (by ``seq`` if there is one, else by id) is meant.
    """
    order = "seq" if "seq" in registry.columns else "document_id"
    rows = registry.filter(X.text("markdown_path") != "")
    whole = F.struct(*registry.columns)
    by_path = rows.groupBy(path_key("markdown_path").alias("k")).agg(F.max_by(whole, order).alias("r"))
    by_name = rows.groupBy(X.source_display("markdown_path").alias("k")).agg(F.max_by(whole, order).alias("r"))
    keyed = files.withColumn("k1", path_key("path")).withColumn("k2", F.regexp_replace("k1", "^" + F_quote(root.lower().rstrip("/") + "/"), "") if root else F.col("k1")).withColumn("k3", X.source_display("path"))
    out = keyed
    for i, side in ((1, by_path), (2, by_path), (3, by_name)):
        out = out.join(side.select(F.col("k").alias(f"k{i}"), F.col("r").alias(f"r{i}")), f"k{i}", "left")
    return out.select(*files.columns, F.coalesce("r1", "r2", "r3").alias("registry"))


def F_quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", "") + r"\E"


def clean_metadata(rows: DataFrame, *names: str) -> Column:
    """The columns as a map of texts without null and empty values; nested values as JSON."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    whole = F.create_map(*[x for c in names for x in (F.lit(c), text(c))])
    return F.map_filter(whole, lambda k, v: v.isNotNull() & (v != ""))


def sidecar(with_content: bool = False) -> Column:
    """A document's row as the JSON that is kept beside its Markdown."""
    names = ["document_id", "source_url", "title", "document_type", "status", "crawled_at", "json_path", "markdown_path", "content_sha256", "content_bytes", "metadata"]
    return F.to_json(F.struct(*names, F.col("markdown_path").alias("file_path"), *([F.col(c) for c in ("content_html", "content_tree", "content_text")] if with_content else [])))


def hashed(rows: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Rows with the hash and length of their Markdown."""
    return rows.withColumn("content_sha256", F.sha2(X.text(markdown), 256)).withColumn("content_bytes", F.octet_length(X.text(markdown)).cast("long"))
