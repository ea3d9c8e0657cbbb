"""Rotations, quantizers, normalisation, sketches, compressors, scoring, allocation and analytics on tables of vectors."""
