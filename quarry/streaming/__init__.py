"""Structured Streaming entry points (incremental scenario ingestion)."""

from quarry.streaming.scenario_feed import objectives_sink, production_stream, start_objectives  # noqa: F401
