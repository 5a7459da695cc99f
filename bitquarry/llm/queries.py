"""The queries of this subpackage, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, covertree, html, licenses, linededup, minhash, packing, records, suffixdedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": minhash.op1_dart_minhash,
    "op2_cover_tree": covertree.op2_cover_tree,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_suffix_array": suffixdedup.op4_suffix_array,
    "op5_decontamination": contamination.op5_decontamination,
    "op6_line_blocks": html.op6_line_blocks,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_token_records": records.op9_token_records,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op1_dart_minhash": minhash.ORACLE_SQL,
    "op2_cover_tree": covertree.ORACLE_SQL,
    "op4_suffix_array": suffixdedup.ORACLE_SQL,
    "op5_decontamination": contamination.ORACLE_SQL,
    "op7_license_scan": licenses.oracle_sql(),
}
