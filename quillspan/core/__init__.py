"""Execution helpers shared by all operators."""
