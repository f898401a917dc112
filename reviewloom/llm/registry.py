"""The registered corpus queries and their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ("language_id", "exact_dedup", "simhash", "decontaminate", "sharding", "mixing", "licenses", "token_output", "toxicity", "personal_data", "secrets", "spelling", "prefix_trie")


def queries():
    found = {"pipeline": corpus_pipeline.run}
    for name in MODULES:
        found.update(import_module(f"reviewloom.llm.{name}").QUERIES)
    return found


def oracles():
    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for name in MODULES:
        found.update(getattr(import_module(f"reviewloom.llm.{name}"), "ORACLES", {}))
    return found
