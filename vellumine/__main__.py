"""``python -m vellumine crawl|ingest|answer|evaluate``: acquisition, and whole runs over folders and JSON questions."""

from __future__ import annotations

import argparse
import dataclasses
import json
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumine.functions import patterns as P
from vellumine.operators import evaluation as E
from vellumine.plans import acquire
from vellumine.plans import pipeline as L
from vellumine.plans import settings as S
from vellumine.sources import client as W
from vellumine.sources import files
from vellumine.sources import registry as Reg


def names(value: str) -> tuple[str, ...]:
    """A list with commas."""
    return tuple(x.strip() for x in value.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("vellumine")
    sub = p.add_subparsers(dest="command", required=True)
    base = S.load()
    crawl, ingest, answer, evaluate = (sub.add_parser(n) for n in ("crawl", "ingest", "answer", "evaluate"))
    crawl.add_argument("--keyword", default="lao động")
    crawl.add_argument("--keyword-scope", choices=("title", "all"), default="title")
    crawl.add_argument("--document-types", type=names, default=P.DOCUMENT_TYPES)
    crawl.add_argument("--statuses", type=names, default=P.STATUSES)
    crawl.add_argument("--output-dir", default="data/raw/vbpl")
    crawl.add_argument("--registry", help="a Parquet table; by default registry.parquet in the output folder")
    crawl.add_argument("--write-json", action="store_true", help="metadata beside each Markdown file")
    crawl.add_argument("--include-content-json", action="store_true", help="with the content tree and text")
    crawl.add_argument("--max-docs", type=int)
    crawl.add_argument("--delay-seconds", type=float, default=0.5)
    crawl.add_argument("--api-base", default=W.BASE)
    for s in (ingest, answer, evaluate):
        s.add_argument("--index-dir", default=base.paths.index_dir)
    ingest.add_argument("--data-dir", default=base.paths.data_dir)
    ingest.add_argument("--registry", help="a Parquet table of registry rows")
    ingest.add_argument("--work-dir", required=True, help="a folder that driver and executors share")
    ingest.add_argument("--sidecar-dir", help="JSON files beside the documents, whose content trees state relations too")
    ingest.add_argument("--reset", action="store_true", help="leave out what the index has; otherwise documents are added or replaced")
    ingest.add_argument("--audit-output", help="a folder for the counts of the graph's facts, as JSON")
    for part, subs in ((S.Chunking, (ingest,)), (S.Graph, (ingest, answer, evaluate)), (S.Retrieval, (answer, evaluate))):
        for f in dataclasses.fields(part):
            kind = S.flag if isinstance(f.default, bool) else type(f.default) if f.default is not None else S.optional_float
            for s in subs:
                s.add_argument("--" + f.name.replace("_", "-"), type=kind, default=None)
    for s in (answer, evaluate):
        s.add_argument("--questions", required=True, help="a JSON list of questions")
    evaluate.add_argument("--ground-truths", required=True, help="a JSON list of answers, as many")
    evaluate.add_argument("--output", required=True)
    return p


def configured(args: argparse.Namespace) -> S.Settings:
    """The environment's settings under what the arguments give."""
    base, given = S.load(), {k: v for k, v in vars(args).items() if v is not None}
    own = {f.name: dataclasses.replace(part := getattr(base, f.name), **{x.name: given[x.name] for x in dataclasses.fields(part) if x.name in given}) for f in dataclasses.fields(base)}
    return dataclasses.replace(base, **own)


def crawled(spark: SparkSession, args: argparse.Namespace, client: W.Client) -> int:
    """Search, fetch and store documents: pages as JSON lines, Markdown files, and the registry; returns the documents stored."""
    out, run = args.output_dir.rstrip("/"), int(time.time() * 1000)
    pages = f"{out}/api/{run}"
    fetch = client.pages(args.keyword, args.keyword_scope, args.document_types, args.statuses)
    Reg.write_pages(Reg.api_pages(fetch, W.PAGE_SIZE, args.max_docs), spark, f"{pages}/search")
    items = Reg.read_pages(spark, f"{pages}/search").select(F.inline("items"))
    chosen = acquire.select(items, args.keyword, args.keyword_scope, args.document_types, args.statuses, args.max_docs)
    ids = (r["document_id"] for r in chosen.select("document_id").orderBy("document_id").toLocalIterator())
    Reg.write_pages(client.details(ids), spark, f"{pages}/details")
    empty = spark.createDataFrame([], f"items array<struct<{Reg.ITEM}>>, total bigint")
    found = Reg.read_pages(spark, f"{pages}/details") if not chosen.isEmpty() else empty
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    docs = acquire.documents(chosen, found.select(F.inline("items")), now)
    docs.write.mode("overwrite").parquet(f"{pages}/documents")
    docs = spark.read.parquet(f"{pages}/documents")
    named = files.file_names(docs.filter("error IS NULL").withColumn("doc_number", F.col("metadata")["so_ky_hieu"]))
    named = named.withColumn("markdown_path", F.concat(F.lit("markdown/"), "file")).withColumn("json_path", F.when(F.lit(args.write_json), F.concat(F.lit("json/"), F.regexp_replace("file", r"\.md$", ".json"))))
    stored = files.write_files(named, f"{out}/markdown").count()
    if args.write_json:
        own = named.withColumn("content_html", F.lit(None).cast("string")).withColumn("json", Reg.sidecar(args.include_content_json))
        files.write_files(own.withColumn("name", F.regexp_replace("file", r"\.md$", ".json")), f"{out}/json", "name", "json").count()
    table = (args.registry or f"{out}/registry.parquet").rstrip("/")
    old = acquire.opened(spark, table)
    new = acquire.registered(old, docs.drop("markdown_path").join(named.select("document_id", "markdown_path", "json_path"), "document_id", "left"), run)
    new.write.mode("overwrite").parquet(f"{pages}/registry")  # the old table is read until this is written
    spark.read.parquet(f"{pages}/registry").write.mode("overwrite").parquet(table)
    return stored


def ingested(spark: SparkSession, args: argparse.Namespace, settings: S.Settings) -> L.Index:
    """Build or extend the index of a folder."""
    rows = files.markdown_folder(spark, args.data_dir)
    if args.registry:
        rows = L.with_metadata(rows, spark.read.parquet(args.registry))
    else:
        rows = rows.withColumn("document_id", F.sha1("path")).withColumnRenamed("path", "markdown_path").select("content", *[c for c in P.DOCUMENT_KEYS if c in ("document_id", "markdown_path")])
    before = None if args.reset else L.parsed_before(spark, args.index_dir)
    sidecars = files.sidecar_folder(spark, args.sidecar_dir) if args.sidecar_dir else None
    index = L.build(rows, settings, folder=f"{args.work_dir.rstrip('/')}/{uuid.uuid4().hex}", before=before, sidecars=sidecars).write(args.index_dir)
    if args.audit_output:
        files.write_audit(index.audit, args.audit_output)
    return index


def main(argv: list[str] | None = None, client: W.Client | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "crawl":
        print(json.dumps({"documents": crawled(spark, args, client or W.Client(W.over_http(args.api_base), args.delay_seconds))}))
        return
    settings = configured(args)
    if args.command == "ingest":
        ingested(spark, args, settings)
        return
    asked = list(enumerate(json.loads(args.questions)))
    queries, index = spark.createDataFrame(asked, "query_id long, text string"), L.open_index(spark, args.index_dir)
    if args.command == "answer":
        for r in L.answer(queries, index, settings).select("query_id", "text", "answer").orderBy("query_id").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return
    truths = spark.createDataFrame(list(enumerate(json.loads(args.ground_truths))), "query_id long, ground_truth string")
    rows = L.evaluate(queries, truths, index, settings)
    files.write_scores(rows, args.output)
    print(json.dumps(E.means(rows).first().asDict()))


if __name__ == "__main__":
    main()
