"""Training-data operators: one module per operator, `queries.py` for the registered queries."""
