"""Structured Streaming over order events, and the batch twins."""
