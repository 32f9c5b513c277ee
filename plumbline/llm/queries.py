"""Registered queries of the text operators, by the name that the driver calls."""

from __future__ import annotations

from plumbline.llm import (
    bpe,
    fingerprints,
    html_text,
    lexical_search,
    license_rules,
    line_dedup,
    near_dedup,
    packing,
    quality_rules,
    sharding,
    vector_codes,
    vector_search,
    warc,
)
from plumbline.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_license_scan": license_rules.query,
    "op3_line_dedup": line_dedup.query,
    "op4_html_text": html_text.query,
    "op5_fingerprints": fingerprints.query,
    "op6_packing": packing.query,
    "op7_bpe": bpe.query,
    "op8_warc": warc.query,
    "op9_near_dedup": near_dedup.query,
    "op10_quality_rules": quality_rules.query,
    "op11_vector_codes": vector_codes.query,
    "op12_vector_search": vector_search.query,
    "op13_lexical_search": lexical_search.query,
}
