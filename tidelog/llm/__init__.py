"""Operators for preparing training data: search, filters, duplicates, packing, token files.

Nothing else in the package imports this one. `queries` registers one query per operator.
"""
