"""Incremental builds and stateful folds."""
