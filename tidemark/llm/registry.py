"""Queries of this package and their SQL."""

from __future__ import annotations

from tidemark.llm import (
    chat,
    decontaminate,
    exact_dedup,
    html_extract,
    language,
    licenses,
    line_dedup,
    manifest,
    merkle,
    packing,
    pii,
    simhash,
    whitening,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat": chat.op3_chat,
    "op4_merkle": merkle.op4_merkle,
    "op5_pii": pii.op5_pii,
    "op6_html": html_extract.op6_html,
    "op7_packing": packing.op7_packing,
    "op8_licenses": licenses.op8_licenses,
    "op9_simhash": simhash.op9_simhash,
    "op10_language": language.op10_language,
    "op11_whitening": whitening.op11_whitening,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_manifest": manifest.op13_manifest,
}

ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_chat": chat.ORACLE,
    "op4_merkle": merkle.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
