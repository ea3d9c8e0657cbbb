"""Presets, composite evaluations and the registered queries."""
