"""Registered queries against their DuckDB twins on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from verify import frame
from vellumine.plans import catalogue as Q

SF = "/root/testdata/sf0.001"
FAST = (
    "references", "amendments", "doc_relations", "graph_edges", "anchor_clauses", "bm25_topk", "term_df_idf", "knn_filtered_by_label", "rrf_weighted", "rrf_trace", "rerank_threshold_topk",
    "context_pack_dedupe", "compact_context", "verify_answers", "registry_error_upsert", "file_registry_lookup", "text_functions", "event_counts", "normalize_headings", "resolve_targets", "external_scopes", "audit", "strip_preamble", "dedupe_exact_content", "dedupe_keep_best", "knn_index_recall",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_twin(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert frame([tuple(r) for r in df.collect()], df.columns) == frame(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", ["chunk_recursive", "chunk_headers", "html_blocks", "html_title_text"])
def test_rows_only(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
