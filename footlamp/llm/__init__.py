"""Operators for large text corpora, each with a registered query."""

from footlamp.llm import importance, language, license_scan, mixing, neighbours, quality, sentencepiece_lattice, simhash, spelling, token_files, toxicity, url_filter, warc
from footlamp.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "importance", "language", "license_scan", "mixing", "neighbours", "quality", "sentencepiece_lattice", "simhash", "spelling", "token_files", "toxicity", "url_filter", "warc"]
