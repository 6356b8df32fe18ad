"""Readers, sinks and the mapping of sample tables onto the fact tables."""
