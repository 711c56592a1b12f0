"""Operators for corpus preparation. Nothing outside this package imports it."""
