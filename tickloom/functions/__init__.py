"""Scalar expressions shared by operators."""
