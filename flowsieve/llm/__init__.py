"""Operators for preparing training data: one module an operator, `queries.py` registers them."""
