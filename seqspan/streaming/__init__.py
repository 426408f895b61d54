"""Watching folders as streams."""
