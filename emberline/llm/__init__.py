"""Operators for preparing training text: sharding, scoring, deduplication, formatting and packing.

Nothing else in the library imports this subpackage.
"""
