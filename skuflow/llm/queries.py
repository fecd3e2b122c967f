"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from skuflow.llm import (bpe, centroids, chat_format, decontaminate, divergence, html_template, language_id, near_dedup,
                         pii, quality_rules, sharding, topk_join, warc)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (warc, quality_rules, bpe, chat_format, decontaminate, html_template, sharding, pii,
               near_dedup, language_id, centroids, topk_join, divergence):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
