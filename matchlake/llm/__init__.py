"""Operators for large-scale text corpora: filtering, scoring, deduplication, mixing and sharding.

Nothing outside this subpackage imports it.
"""
