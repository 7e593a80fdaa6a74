"""Training-data operators: ten document operators and their queries.

Nothing else in the library imports this subpackage.
"""
