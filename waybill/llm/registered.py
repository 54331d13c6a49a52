"""Registered queries of this subpackage and their SQL counterparts.

Queries without SQL here are held against brute-force versions in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybill.llm import (
    license_scans,
    manifest,
    mixing,
    ngram_join,
    packing,
    pii,
    quality_rules,
    ranked_search,
    secret_scans,
    token_counts,
    topk_search,
    url_filters,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1,
    "op2_ngram_join": ngram_join.op2,
    "op3_license_scans": license_scans.op3,
    "op4_secret_scans": secret_scans.op4,
    "op5_pii": pii.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_token_counts": token_counts.op7,
    "op8_topk_search": topk_search.op8,
    "op9_warc": warc.op9,
    "op10_mixing": mixing.op10,
    "op11_ranked_search": ranked_search.op11,
    "op12_url_filters": url_filters.op12,
    "op13_manifest": manifest.op13,
}

ORACLE_SQL = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op8_topk_search": topk_search.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_manifest": manifest.OP13_SQL,
}
