"""Structured Streaming forms of the series operators."""
