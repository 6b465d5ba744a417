"""Scalar functions: text, URLs, vectors."""
