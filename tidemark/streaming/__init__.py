"""Stateful online scoring with Structured Streaming."""
