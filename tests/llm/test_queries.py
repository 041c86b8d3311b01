"""The queries over the smallest test tables, against SQL where there is some."""

import os

import duckdb
import pytest

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_pivots": ["vec_id", "n_links", "component_id", "kept"],
    "op2_html": ["page_id", "url", "text", "n_chars"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_topk": ["query_id", "rank", "vec_id", "score"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    table = "embeddings" if name in ("op1_pivots", "op4_topk") else "pages" if name in ("op2_html", "op10_warc") else "documents"
    if name != "op4_topk":
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        result = con.execute(sql)
        assert [d[0] for d in result.description] == df.columns
        assert sorted(map(str, rows)) == sorted(map(str, result.fetchall()))


def test_token_files_and_encoder_agree(spark):
    """Two ways to the same ids: the library by words, and the pair index."""
    a = queries.queries()["op8_token_files"](spark, DATA).select("doc_id", "n_tokens").collect()
    b = queries.queries()["op9_bpe"](spark, DATA).select("doc_id", "n_tokens").collect()
    assert {r.doc_id: r.n_tokens - 1 for r in a} == {r.doc_id: r.n_tokens for r in b}
