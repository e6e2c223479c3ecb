"""Operators on fields and particles."""
