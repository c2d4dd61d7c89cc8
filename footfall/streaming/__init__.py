"""Continuous processing with Structured Streaming."""
