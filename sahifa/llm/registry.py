"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module; each module has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
OPERATORS = {
    "op1_url_filter": "urlfilter",
    "op2_suffix_dedup": "suffix",
    "op3_token_binary": "tokenbin",
    "op4_hnsw_dedup": "hnsw",
    "op5_bpe_encode": "bpe",
    "op6_quality_crf": "quality",
    "op7_ann_kdtree": "annkd",
    "op8_warc_bundles": "warc",
    "op9_simhash_golay": "simhash",
    "op10_mix_sources": "mixing",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}
