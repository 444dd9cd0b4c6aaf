"""Operators over DataFrames: joins, window-like scans, rankings and set operations."""
