"""Operators for building training corpora: counting, mixing, packing, formatting,
deduplication, filtering, archiving and classification.

Nothing outside this package imports it; ``registry`` lists its queries and SQL.
"""
