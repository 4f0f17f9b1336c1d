"""Operators for preparing training data: scoring, cleaning, near-duplicate search, packing, sharding and archives.

Nothing else in the library imports this subpackage.
"""
