"""Queries of this subpackage and, where SQL can express them, their SQL."""

from lexgrid.llm import bpe, decontamination, jaccard_join, language, line_dedup, pii, quality_classifier, quality_rules, substring_dedup, warc

_MODULES = (bpe, language, decontamination, jaccard_join, warc, quality_rules, quality_classifier, pii, substring_dedup, line_dedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
