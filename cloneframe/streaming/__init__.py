"""Structured Streaming: arriving repertoires searched against a fixed set."""
