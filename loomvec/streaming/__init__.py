"""Streams of vectors into a compressed cache."""
