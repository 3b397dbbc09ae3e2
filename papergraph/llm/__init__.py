"""Training-data operators: one module an operator, ``registry`` for the queries."""
