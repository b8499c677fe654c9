"""Structured Streaming filters over mesh events."""
