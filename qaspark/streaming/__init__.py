"""Structured Streaming forms of the metric and extraction operators."""
