"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "secret_scan",
    "quality_rules",
    "warc_archive",
    "token_counts",
    "line_dedup",
    "decontaminate",
    "mixing",
    "suffix_dedup",
    "near_dup",
    "toxicity",
    "hard_negatives",
    "conversation_repair",
    "quality_classifier",
)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
