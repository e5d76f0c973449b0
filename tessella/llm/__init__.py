"""Training-data operators on Spark DataFrames: one module for each operator.

Nothing outside this subpackage imports it.
"""
