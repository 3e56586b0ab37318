"""The queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module of this subpackage
WHERE = {
    "p1_found": "lookalike",
    "p1_canonical": "lookalike",
    "p2_found": "pairs",
    "p2_surprise": "pairs",
    "p2_counts": "pairs",
    "p3_found": "termcounts",
    "p3_terms": "termcounts",
    "p3_after_changes": "termcounts",
    "p4_found": "langid",
    "p4_languages": "langid",
    "p5_found": "sentences",
    "p5_sentences": "sentences",
    "p6_found": "mojibake",
    "p6_restored": "mojibake",
    "p7_found": "boilerplate",
    "p7_site_lines": "boilerplate",
    "p7_cleaned": "boilerplate",
    "p8_containers": "packing",
    "p8_complete": "packing",
    "p8_fill": "packing",
    "p9_found": "leakage",
    "p9_documents": "leakage",
    "p10_found": "readlevel",
    "p10_levels": "readlevel",
}


def _run(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(module, name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.SQL)
