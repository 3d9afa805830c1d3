"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> (module, function, name of its DuckDB SQL or None).
OPERATORS = {
    "op1_media_chunks": ("media", "op1", None),
    "op2_packing": ("pack", "op2", None),
    "op4_simhash_near_dedup": ("simhash", "op4", None),
    "op10_fingerprints": ("fingerprint", "op10", None),
    "op3_toxicity": ("toxicity", "op3", None),
    "op5_quality": ("quality", "op5", None),
    "op6_id_files": ("idfile", "op6", None),
    "op7_edited_token_counts": ("edits", "op7", None),
    "op8_chat_formatting": ("chat", "op8", "OP8_SQL"),
    "op9_mixing": ("mix", "op9", "OP9_SQL"),
    "op11_vector_codes": ("codes", "op11", "OP11_SQL"),
    "op12_filter_audit": ("audit", "op12", "OP12_SQL"),
    "op13_line_dedup": ("lines", "op13", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, _, sql) in OPERATORS.items() if sql}
