"""Structured Streaming over processing events."""
