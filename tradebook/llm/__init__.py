"""Operators for preparing training data: deduplication, packing, tokenizing, formatting, search.

They pass further columns through or ignore them; names that begin with ``_llm_`` are their own.
"""
