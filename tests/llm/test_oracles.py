"""Registered queries of the subpackage against their SQL, and their result columns."""

import os
import sys

import duckdb
import pytest

from affinis.llm.queries import LLM_REGISTRY

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import norm_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
#: First result columns of each query.
COLUMNS = {
    "op1": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "doc_id item_id n_item_shingles n_shared containment",
    "op4": "page_id payload_bytes payload_digest record_type refers_to",
    "op5": "doc_id p_low p_toxic low_rate toxic_rate keep",
    "op6": "doc_id size source_size target taken first_position",
    "op7": "doc_id n_shingles component_id kept",
    "op8": "page_id url text n_chars",
    "op9": "doc_id n_bytes n_tokens over_limit",
    "op10": "doc_id n_words n_removed kept_sha256",
    "op11": "page_id host path rule verdict",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", LLM_REGISTRY)
def test_query(spark, name):
    fn, sql = LLM_REGISTRY[name]
    df = fn(spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]].split()
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert norm_rows(df.columns, rows) == norm_rows(names, found.fetchall())
