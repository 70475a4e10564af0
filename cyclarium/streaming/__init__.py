"""Structured Streaming versions of the frame-level operators."""
