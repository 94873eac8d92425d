"""Extraction, ignore rules, incremental maintenance, aggregates and result shaping."""
