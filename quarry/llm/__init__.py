"""Operators of a training-data pipeline: packing, deduplication, extraction, filtering, mixing, secret scans.

Nothing outside this package imports it.  ``quarry.llm.entry`` holds the
registered queries ``opN_<name>`` and their DuckDB SQL.
"""
