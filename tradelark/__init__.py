"""Marketplace analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame. Nothing runs until
the caller acts on the result, with one stated exception: the helpers in
``tradelark.plans.staging`` write a table so that later steps can read it back.
"""

from tradelark.market import Market

__all__ = ["Market"]
__version__ = "0.1.0"
