"""Event operators on Structured Streaming."""
