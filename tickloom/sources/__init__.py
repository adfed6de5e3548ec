"""Readers, writers and the tables derived from the shared test tables."""
