"""The queries over the smallest tables: columns, whole results, and the SQL of those that have it."""

import os

import duckdb
import pytest

from sparkmeter.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ("documents", {"doc_id", "fingerprint", "component_id"}),
    "op2_suffix_array_dedup": ("documents", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
    "op3_license_scan": ("documents", {"doc_id", "path", "license", "score", "origin", "from_path"}),
    "op5_lm_scoring": ("documents", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}),
    "op6_html_extraction": ("pages", {"page_id", "url", "text", "n_chars"}),
    "op9_mixing": ("documents", {"doc_id", "size", "source_size", "target", "taken", "draws"}),
    "op10_embedding_near_dedup": ("embeddings", {"vec_id", "n_links", "component_id", "kept"}),
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_row(spark, name):
    table, columns = COLUMNS[name]
    out = QUERIES[name](spark, DATA)
    assert set(out.columns) == columns
    assert out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
