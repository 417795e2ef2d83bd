"""Operators: DataFrame in, DataFrame out, the same for batch and streaming where noted."""
