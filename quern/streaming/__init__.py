"""Structured Streaming versions of the additive operators."""
