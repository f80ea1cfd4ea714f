"""Searches and changes that arrive as streams."""
