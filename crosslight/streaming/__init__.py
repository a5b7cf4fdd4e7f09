"""Continuous forms of the operators on Structured Streaming."""
