"""Command logs as streams."""
