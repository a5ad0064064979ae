"""Operators for preparing training data: filters, scores, searches, packing, output, sharding.

Nothing else in the library imports this folder.
"""
