"""Readers of raw inputs and table sinks."""
