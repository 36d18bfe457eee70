"""Operators that a training-data pipeline needs: sharding, deduplication, language, filters, mixing, search.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` holds the thin contract queries over the driver's tables and ``oracles`` their SQL.
"""
