"""Operators for large text corpora; an optional subpackage that nothing else in the library imports."""
