"""Corpus operators for training data: the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this package that holds it; a module's ORACLE_SQL is its DuckDB counterpart.
MODULES = {
    "op1_topk": "topk",
    "op2_quality": "quality",
    "op3_repeats": "repeats",
    "op4_toxicity": "toxicity",
    "op5_editcount": "editcount",
    "op6_packing": "packing",
    "op7_warc": "warc",
    "op8_simhash": "simhash",
    "op9_mixing": "mixing",
    "op10_token_files": "tokenbin",
    "op11_filteraudit": "filteraudit",
    "op12_secrets": "secrets",
    "op13_crossalign": "crossalign",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
