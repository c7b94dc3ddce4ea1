"""Formats, files and tables as sources of entries."""
