"""The queries of this subpackage, by the names that the entry module registers."""

from __future__ import annotations

from palimpsest.llm import bpe, exact_dedup, fingerprints, mixing, near_dedup, preferences, quality, secrets, substrings, token_files

MODULES = {
    "op1_quality": quality,
    "op2_mix_sources": mixing,
    "op3_bpe": bpe,
    "op4_suffix_dedup": substrings,
    "op5_fingerprints": fingerprints,
    "op6_secrets": secrets,
    "op7_token_files": token_files,
    "op8_near_dedup": near_dedup,
    "op9_preferences": preferences,
    "op10_exact_dedup": exact_dedup,
}

QUERIES = {name: module.query for name, module in MODULES.items()}
ORACLES = {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
