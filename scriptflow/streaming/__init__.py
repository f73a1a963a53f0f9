"""Structured Streaming jobs over process output."""
