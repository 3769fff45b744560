"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import binary_output, bsi_search, chat_format, lattice_lm, mixing, near_dedup, packing, quality_rules, toxicity, url_filter
from .oracles import SQL

QUERIES = {
    "op1_bsi_search": bsi_search.query,
    "op2_chat_format": chat_format.query,
    "op3_quality_rules": quality_rules.query,
    "op4_near_dedup": near_dedup.query,
    "op5_url_filter": url_filter.query,
    "op6_binary_output": binary_output.query,
    "op7_lattice_lm": lattice_lm.query,
    "op8_mixing": mixing.query,
    "op9_toxicity": toxicity.query,
    "op10_best_fit_packing": packing.query,
}

__all__ = ["QUERIES", "SQL"]
