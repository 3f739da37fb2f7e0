"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm import ball_kmeans, chat_format, decontamination, html_extract, kneser_ney, license_scan, near_dedup, quality_rules, sharding, source_mix, substring_dedup, token_alignment, url_rules

MODULES = (sharding, kneser_ney, quality_rules, decontamination, html_extract, near_dedup, url_rules, substring_dedup, license_scan, source_mix, chat_format, token_alignment, ball_kmeans)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
