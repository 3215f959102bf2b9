"""Batch operators, one module per area."""
