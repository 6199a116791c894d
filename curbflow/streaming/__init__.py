"""Incremental runs: new files as they arrive, slot counts on streams."""
