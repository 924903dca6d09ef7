"""The numbered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from ..session import ship_package
from . import decontaminate, fill_middle, fm_index, licenses, line_dedup, minhash, mixing, periodic, pii, suffix_array, superminhash, toxicity, url_filter


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_array_dedup": suffix_array.op2_suffix_array_dedup,
    "op3_fm_index_dedup": fm_index.op3_fm_index_dedup,
    "op4_document_fingerprints": minhash.op4_document_fingerprints,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_superminhash_dedup": superminhash.op6_superminhash_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_personal_data": pii.op11_personal_data,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}

SQL = {
    "op2_suffix_array_dedup": suffix_array.OP2_SQL,
    "op3_fm_index_dedup": fm_index.OP3_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_superminhash_dedup": superminhash.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_personal_data": pii.OP11_SQL,
    "op12_fill_in_middle": fill_middle.OP12_SQL,
}
