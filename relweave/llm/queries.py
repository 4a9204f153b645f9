"""The queries over the training-data operators, by name."""

from __future__ import annotations

import importlib

#: Query name, module and function.
QUERIES = {
    "op1_langid": "langid",
    "op2_spotsigs": "spotsigs",
    "op3_bpe": "bpe_codec",
    "op4_secrets": "secrets",
    "op5_knn": "knn",
    "op6_jaccard": "jaccard_join",
    "op7_suffix": "suffix_dedup",
    "op8_lm": "lm_score",
    "op9_html": "html_extract",
    "op10_packing": "packing",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"relweave.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
