"""Operators for large text corpora: deduplication, packing, filters, scans, tokens.

Nothing outside this package imports it.
"""
