"""The registered queries of the corpus operators, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import ann, bpe, codes, merkle, mixing, neardup, pii, quality, sharding, topk, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundle": warc.op1_warc_bundle,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ann": ann.op5_ann,
    "op6_top_k": topk.op6_top_k,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_annular_codes": codes.op12_annular_codes,
    "op13_virtual_slots": sharding.op13_virtual_slots,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_bundle": warc.ORACLE,
    "op2_url_filter": urlfilter.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op8_source_mix": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_annular_codes": codes.ORACLE,
    "op13_virtual_slots": sharding.ORACLE,
}
