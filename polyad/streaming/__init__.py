"""Structured Streaming: an extension, for the reference model is batch only."""
