"""Versions of tables."""

from .versions import apply_changes, drop_purged, latest_version, read_table, read_version, write_changes, write_version

__all__ = ["apply_changes", "drop_purged", "latest_version", "read_table", "read_version", "write_changes", "write_version"]
