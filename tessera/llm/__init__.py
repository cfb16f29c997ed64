"""Training-data operators: one module for each, plus the shared helpers and the registered queries.

Nothing else in the library imports this package.
"""
