"""Pieces that turn a format's declarations into Spark columns."""
