"""Readers and writers of vectors, metadata, manifests and results."""
