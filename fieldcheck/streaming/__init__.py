"""Incremental change detection over a stream of action-log files."""
