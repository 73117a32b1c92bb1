"""Structured Streaming: publication of fresh tiles."""
