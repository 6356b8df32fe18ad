"""Operators for preparing training data from documents."""
