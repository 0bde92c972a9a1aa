"""Training-data operators: one module per problem, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
