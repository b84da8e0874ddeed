"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_chat_formatting": "chat_format",
    "op2_language_id": "language_id",
    "op3_substring_dedup": "compact_windows",
    "op4_bpe_automaton": "bpe_automaton",
    "op5_minhash_near_dedup": "minhash_dedup",
    "op6_benchmark_decontamination": "decontaminate",
    "op7_url_filter": "url_filter",
    "op8_quality_rules": "quality_rules",
    "op9_line_dedup": "line_dedup",
    "op10_html_extraction": "html_extract",
    "op11_suffix_dedup": "prefix_doubling",
    "op12_fill_in_middle": "fill_in_middle",
    "op13_hard_negatives": "hard_negatives",
}

_LOADED = {name: importlib.import_module(f".{module}", __package__) for name, module in _MODULES.items()}
QUERIES = {name: module.query for name, module in _LOADED.items()}
SQL = {name: module.SQL for name, module in _LOADED.items() if getattr(module, "SQL", None)}
