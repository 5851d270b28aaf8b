"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from tessera.llm import decontam, licenses, pii, quality, sentencepiece_fst, simhash, substring, token_io, toxicity, urlfilter
from tessera.llm.common import table

QUERIES = {
    "op1_sentencepiece": lambda spark, d: sentencepiece_fst.encode(table(spark, d, "documents")),
    "op2_substring_dedup": lambda spark, d: substring.dedup_substrings(table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: urlfilter.judge(table(spark, d, "pages")),
    "op5_token_ids": lambda spark, d: token_io.round_trip(table(spark, d, "documents"), added_tokens=True),
    "op6_pii": lambda spark, d: pii.find(table(spark, d, "documents")),
    "op7_decontamination": lambda spark, d: decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_license_scan": lambda spark, d: licenses.scan(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring.ORACLE,
    "op4_url_filter": urlfilter.ORACLE,
}
