"""Training-data operators: one module per operator, see README.md."""
