"""Incremental training and scoring on streams."""
