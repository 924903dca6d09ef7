"""The numbered queries against their SQL on the smallest driver tables, and their contracts' columns."""

import os

import duckdb
import pytest

from tarnflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op3": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"], "op6": ["doc_id", "n_shingles", "component_id", "kept"], "op8": ["page_id", "host", "path", "rule", "verdict"],
    "op11": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op12": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and set(COLUMNS.get(name.split("_")[0], [])) <= set(df.columns)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        rel = con.sql(queries.SQL[name])
        cols = sorted(df.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr) == sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
