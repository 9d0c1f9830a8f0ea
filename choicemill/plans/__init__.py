"""Chains of operators over concrete tables, with their written stages."""
