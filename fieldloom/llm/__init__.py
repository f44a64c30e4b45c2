"""Operators that prepare training corpora, each with its registered query."""
