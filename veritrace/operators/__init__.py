"""Relational operators, one module per stage."""
