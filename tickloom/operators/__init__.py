"""Relational and windowed operators over order-book tables."""
