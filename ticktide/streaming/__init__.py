"""Structured Streaming forms of the bar operators."""
