"""Operators for preparing training data: deduplication, packing, mixing, scans, scoring and search.

Nothing outside this subpackage imports it.
"""
