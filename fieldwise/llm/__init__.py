"""Operators for building training corpora: filters, near-duplicate joins, mixing, token output."""
