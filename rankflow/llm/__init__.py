"""Operators for preparing training data: filters, near copies, scores, packing.

Nothing else in the library imports this subpackage.
"""
