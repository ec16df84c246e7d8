"""Operators for preparing training data: duplicates, decontamination, scoring, mixing, packing, formatting."""
