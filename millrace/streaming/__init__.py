"""Structured Streaming, beyond what the dialect has."""
