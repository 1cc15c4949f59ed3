"""Operators for large-scale training-data preparation.

One module per operator; ``queries`` registers one thin query for each of
them. Nothing else in the library imports this subpackage.
"""
