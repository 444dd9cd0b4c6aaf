"""Scans of pages and documents, and sinks."""
