"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every operator module; each registers its query."""
    from . import (  # noqa: F401
        op1_token_output,
        op2_quality_rules,
        op3_fingerprints,
        op4_near_dedup,
        op5_line_dedup,
        op6_sentencepiece,
        op7_toxicity,
        op8_pii_surrogates,
        op9_license_digests,
        op10_bounded_packing,
        op11_exact_dedup,
        op12_filter_audit,
        op13_collocations,
    )
