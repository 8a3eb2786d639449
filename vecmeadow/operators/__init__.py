"""Joins, aggregates, ordered scans and composites over DataFrames."""
