"""All queries of this subpackage, the pipeline among them, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "license_scan", "parity_join", "string_tiling", "line_dedup", "line_crf", "chat_windows", "lm_scoring", "substring_dedup", "curriculum",
    "quality_rules", "coordinate_join", "token_alignment", "whitening",
)


def load_catalog():
    for name in MODULES:
        import_module(f"loomtab.llm.{name}")
    pipeline = import_module("corpus_pipeline")
    from loomtab.llm.common import ORACLES, QUERIES

    sql = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return {**QUERIES, "pipeline": pipeline.run}, ORACLES | sql
