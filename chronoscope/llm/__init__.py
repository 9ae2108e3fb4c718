"""Training-data operators: ten corpus operations built on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
