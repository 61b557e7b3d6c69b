"""Structured Streaming: landing files, running profiles and the question log."""
