"""Operators for training-data corpora: dedup, decontamination, quality, scoring, encoding."""
