"""The corpus queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bitsliced, chat_format, collocation, decontaminate, html_extract, license_scan, merkle, mixing, partenum, suffix_dedup, token_output, toxicity, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_jaccard_join": partenum.op5_jaccard_join,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_exact_topk": bitsliced.op7_exact_topk,
    "op8_token_output": token_output.op8_token_output,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_chat_formatting": chat_format.op11_chat_formatting,
    "op12_collocations": collocation.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op2_html_extraction": html_extract.ORACLE_SQL,
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op7_exact_topk": bitsliced.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op12_collocations": collocation.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
