"""Operators for training-data pipelines: one module per operator, ``queries`` for the registered queries."""
